"""DuckDB SQL for the queries of this subpackage that SQL can express at small sizes."""

from __future__ import annotations

VECTORS = """good AS (SELECT vec_id, min(embedding)::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id)"""

# The smallest node reached over links (a, b) from every node.
COMPONENTS = """reach AS (SELECT node, node AS c FROM nodes UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.node),
components AS (SELECT node, min(c) AS component_id FROM reach GROUP BY node)"""

NEAR_VECTORS = f"""WITH RECURSIVE {VECTORS},
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE len(list_filter(x.v, lambda z: z <> 0)) > 0 AND len(list_filter(y.v, lambda z: z <> 0)) > 0
    AND list_cosine_similarity(x.v, y.v) >= 0.9),
nodes AS (SELECT DISTINCT vec_id AS node FROM embeddings),
{COMPONENTS},
counts AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN components ON node = vec_id LEFT JOIN counts USING (node)"""

TOP_SCORES = f"""WITH {VECTORS},
whole AS (SELECT vec_id, list_transform(v, lambda x: floor(256 * x)) AS v FROM good),
pairs AS (SELECT x.vec_id AS query_id, y.vec_id, list_inner_product(x.v, y.v)::BIGINT AS score
  FROM whole x JOIN whole y ON x.vec_id % 50 = 0 AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 5"""

NEAR_DOCUMENTS = f"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
lists AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS s FROM words),
shingles AS (SELECT DISTINCT doc_id, unnest(s) AS s FROM lists),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)),
nodes AS (SELECT DISTINCT doc_id AS node FROM documents),
{COMPONENTS}
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN components ON node = documents.doc_id LEFT JOIN sizes ON sizes.doc_id = documents.doc_id"""

REPEATS = """WITH whole AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
strings AS (SELECT doc_id, i, array_slice(b, i + 1, i + 100) AS s
  FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS i FROM whole)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM strings)
  WHERE nth > 1),
marked AS (SELECT doc_id, i, coalesce(i > lag(i) OVER p + 100, true)::INTEGER AS new FROM later
  WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
spans AS (SELECT doc_id, min(i) AS low, max(i) + 100 AS high
  FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run),
kept AS (SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS low, low AS high FROM spans
  UNION ALL SELECT doc_id, max(high), any_value(octet_length(b)) FROM spans JOIN whole USING (doc_id) GROUP BY doc_id),
rest AS (SELECT doc_id, unhex(string_agg(hex(array_slice(b, low + 1, high)), '' ORDER BY low)) AS b
  FROM kept JOIN whole USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, sum(high - low) AS n, count(*) AS runs FROM spans GROUP BY doc_id)
SELECT doc_id, octet_length(whole.b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans,
  sha256(coalesce(rest.b, whole.b)) AS kept_sha256 FROM whole LEFT JOIN rest USING (doc_id) LEFT JOIN counts USING (doc_id)"""


DIVERGENCE = """WITH rows AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
used AS (SELECT lang, source, row, unnest(terms) AS term FROM rows),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM used GROUP BY ALL HAVING count(DISTINCT row) >= 10),
sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM rows),
grid AS (SELECT lang, source, term, (SELECT count(*) FROM used u WHERE u.lang = s.lang AND u.source = s.source AND u.term = kept.term)::HUGEINT AS n
  FROM sources s JOIN kept USING (lang)),
groups AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM grid GROUP BY ALL),
priced AS (SELECT lang, source, term, grid.n, 1 + 1000000000 * (grid.n + 2) // (groups.total + 2 * v) AS p,
  1 + 1000000000 * (kept.n + 2) // (sizes.total + 2 * v) AS q
  FROM grid JOIN groups USING (lang, source) JOIN kept USING (lang, term) JOIN sizes USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN priced x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN priced y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM priced WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10"""

HARD_NEGATIVES = """WITH good AS (SELECT vec_id, min({'e': embedding::DOUBLE[], 'l': label}) AS row FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
whole AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (row.l + 1) % 10 ELSE row.l END AS label,
  list_transform(row.e, lambda x: floor(256 * x)) AS v FROM good),
pairs AS (SELECT x.vec_id AS anchor_id, y.vec_id, x.label = y.label AS same, list_inner_product(x.v, y.v)::BIGINT AS score
  FROM whole x JOIN whole y ON x.vec_id % 100 = 0 AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negatives AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM positives JOIN pairs USING (anchor_id) WHERE NOT same
    AND 80 * positive_score::HUGEINT <= 100 * score::HUGEINT AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5"""

CHATS = """WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
turns AS (SELECT *, length(replace(replace(role, '\\', '\\\\'), chr(10), '\\n')) + 15 + length(text)
  + len(string_split(text, '###')) - 1 + len(string_split(text, '</turn>')) - 1 AS chars,
  CASE WHEN role = 'assistant' THEN text END AS answer FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(answer)), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(answer, '' ORDER BY turn), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars FROM turns GROUP BY conv_id"""


def oracles() -> dict[str, str]:
    return {
        "op1_hnsw_near_dedup": NEAR_VECTORS,
        "op2_suffix_dedup": REPEATS,
        "op4_impact_search": TOP_SCORES,
        "op5_coordinate_join": NEAR_DOCUMENTS,
        "op11_source_divergence": DIVERGENCE,
        "op12_hard_negatives": HARD_NEGATIVES,
        "op13_chat_formatting": CHATS,
    }
