"""DataFrame operators: ordering, joins, top-k, keywords, evaluation."""
