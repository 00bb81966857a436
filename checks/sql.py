"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from akin.config import PRIME, SearchConfig, permutations
from akin.functions.text import HTML_RULES, ID_BASE, LAST_SHIFT, MIX
from akin.operators.keywords import CHUNK_END, DUPLICATE_LIMIT, SENTENCE_END
from akin.operators.textsearch import WORD_GAP
from checks.queries import (
    CFG,
    FRACTION,
    ID_LIMIT,
    KEYWORD_CONTENT,
    KEYWORD_SIZES,
    KEYWORDS,
    MARKER,
    METRICS,
    NUM_PERMS,
    REPETITIONS,
    SAMPLE,
    SHINGLE_SIZES,
    SIZES,
    TOPS,
    WHOLE,
    WHOLE_SKIP,
)

MASK = (1 << 64) - 1


def chain(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


def clean(column: str = "text") -> str:
    return f"regexp_replace(replace({column}, chr(10), ' '), ' +', ' ', 'g')"


def page_text() -> str:
    out = "html"
    for pattern, replacement in HTML_RULES:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return out


def order_key(seed, column: str = "doc_id") -> str:
    return f"('0x' || substr(md5({seed} || ':' || {column}), 1, 15))::BIGINT"


DOCUMENTS = "corpus AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS title, text FROM documents)"
PAGES = f"""corpus AS (SELECT page_id AS doc_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  {page_text()} AS text FROM pages)"""


def placed(seed="'42'") -> str:
    return f"""placed AS (SELECT *, row_number() OVER (ORDER BY {order_key(seed)}, doc_id) AS pos,
  count(*) OVER () AS n_docs FROM corpus)"""


def holdout(cfg: SearchConfig) -> str:
    d = cfg.query_divisor
    return f"""roles AS (SELECT *, {clean()} AS s, pos <= n_docs - n_docs // {d} AS is_train,
  pos > n_docs - n_docs // {d} AS is_query FROM placed)"""


def whole() -> str:
    return f"roles AS (SELECT *, {clean()} AS s, true AS is_train, pos > {WHOLE_SKIP} AS is_query FROM placed)"


RAW = "roles AS (SELECT *, text AS s FROM corpus)"
CLEAN = f"roles AS (SELECT *, {clean()} AS s FROM corpus)"


def shingles(k: int, name: str = "sh", source: str = "roles") -> str:
    # Long texts are cut into overlapping spans first: substr walks a text from its start.
    return f"""{name} AS (SELECT DISTINCT doc_id, substr(c, i, {k}) AS g FROM (
  SELECT doc_id, c, unnest(generate_series(1, length(c) - {k} + 1)) AS i FROM (
    SELECT doc_id, substr(s, j * 256 + 1, {255 + k}) AS c FROM (
      SELECT doc_id, s, unnest(generate_series(0, (length(s) - {k}) // 256)) AS j FROM {source}
      WHERE length(s) >= {k})))),
{name}_n AS (SELECT doc_id, count(*) AS n FROM {name} GROUP BY doc_id)"""


def sign(k: int, num_perm: int, name: str = "sig", source: str = "sh") -> str:
    """Signatures of a shingle relation; the id is the polynomial of the code points, mixed."""
    value = "unicode(substr(g, 1, 1))::UHUGEINT"
    for j in range(1, k):
        value = f"(({value} * {ID_BASE}::UHUGEINT + unicode(substr(g, {j + 1}, 1))::UHUGEINT) & {MASK}::UHUGEINT)"
    steps = f"SELECT g, {value} AS v FROM (SELECT DISTINCT g FROM {source})"
    for shift, factor in MIX:
        steps = f"SELECT g, (xor(v, v >> {shift}) * {factor}::UHUGEINT) & {MASK}::UHUGEINT AS v FROM ({steps})"
    return f"""{name}_id AS (SELECT g, (xor(v, v >> {LAST_SHIFT}) & {PRIME}::UHUGEINT)::BIGINT AS h FROM ({steps})),
{sign_ids(f"(SELECT doc_id, h FROM {source} JOIN {name}_id USING (g))", num_perm, name)}"""


def sign_ids(ids: str, num_perm: int, name: str) -> str:
    rows = ", ".join(f"({p}, {a}, {b})" for p, (a, b) in enumerate(permutations(num_perm)))
    return f"""{name}_perms(p, a, b) AS (VALUES {rows}),
{name} AS (SELECT doc_id, list(m ORDER BY p) AS sig FROM (
  SELECT doc_id, p, min((a::BIGINT * h + b::BIGINT) % {PRIME}) AS m FROM {ids}, {name}_perms GROUP BY doc_id, p)
  GROUP BY doc_id)"""


QUERIES = "queries AS (SELECT doc_id AS query_id, pos AS qpos FROM roles WHERE is_query)"
TRAIN = "train AS (SELECT doc_id, pos FROM roles WHERE is_train)"


def exact_pairs(sh: str = "sh") -> str:
    return f"""shared AS (SELECT query_id, t.doc_id, count(*) AS shared FROM {sh} q JOIN queries ON q.doc_id = query_id
  JOIN {sh} t ON q.g = t.g JOIN train ON train.doc_id = t.doc_id GROUP BY ALL),
exact_pairs AS (SELECT queries.query_id, t.doc_id, t.pos, coalesce(shared.shared, 0) AS shared,
  coalesce(shared.shared, 0)::DOUBLE / (qn.n + tn.n - coalesce(shared.shared, 0)) AS score
  FROM queries JOIN {sh}_n qn ON qn.doc_id = queries.query_id CROSS JOIN train t
  JOIN {sh}_n tn ON tn.doc_id = t.doc_id
  LEFT JOIN shared ON shared.query_id = queries.query_id AND shared.doc_id = t.doc_id)"""


def same(left: str, right: str) -> str:
    return f"list_sum(list_transform(list_zip({left}, {right}), lambda x: (x[1] = x[2])::INT))::BIGINT"


def sig_pairs(sig: str = "sig", name: str = "sig_pairs", length: int = 0) -> str:
    q, t = ("q.sig", "t.sig") if not length else (f"q.sig[1:{length}]", f"t.sig[1:{length}]")
    return f"""{name} AS (SELECT query_id, doc_id, pos, shared, shared::DOUBLE / n AS score FROM (
  SELECT query_id, t.doc_id, train.pos, {same(q, t)} AS shared, len({q}) AS n
  FROM queries JOIN {sig} q ON q.doc_id = query_id CROSS JOIN train JOIN {sig} t ON t.doc_id = train.doc_id))"""


def top(pairs: str, name: str, n: int) -> str:
    return f"""{name} AS (SELECT query_id, rank, doc_id, shared, score FROM (SELECT *,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM {pairs}) WHERE rank <= {n})"""


def bands(cfg: SearchConfig, sig: str = "sig") -> str:
    b, r = cfg.bands
    return f"""bands AS (SELECT doc_id, band::BIGINT AS band,
  md5(array_to_string(sig[band * {r} + 1 : band * {r} + {r}], ',')) AS bucket FROM {sig}, range({b}) t(band))"""


CANDIDATES = """candidates AS (SELECT DISTINCT query_id, t.doc_id FROM bands q JOIN queries ON q.doc_id = query_id
  JOIN bands t ON q.band = t.band AND q.bucket = t.bucket JOIN train ON train.doc_id = t.doc_id)"""

LSH_EVAL = """lsh_counts AS (SELECT query_id, count(*) AS n_candidates FROM candidates GROUP BY query_id),
lsh_hits AS (SELECT e.query_id, count(c.doc_id) AS hits, count(*) AS n_exact FROM exact_top e
  LEFT JOIN candidates c ON c.query_id = e.query_id AND c.doc_id = e.doc_id GROUP BY e.query_id),
lsh_eval AS (SELECT query_id, n_candidates, hits AS hits_lsh, hits::DOUBLE / n_candidates AS overlap_lsh,
  hits::DOUBLE / n_exact AS recall_lsh FROM lsh_counts JOIN lsh_hits USING (query_id))"""


def list_eval(name: str, listed: str) -> str:
    return f"""{name}_eval AS (SELECT l.query_id, count(e.doc_id) AS hits_{name},
  count(e.doc_id)::DOUBLE / count(*) AS overlap_{name} FROM {listed} l
  LEFT JOIN exact_top e ON e.query_id = l.query_id AND e.doc_id = l.doc_id GROUP BY l.query_id)"""


def corpus_of(cfg: SearchConfig, source: str = DOCUMENTS, roles: str | None = None) -> list[str]:
    """Corpus, roles, shingles, signatures."""
    return [
        source,
        placed(),
        roles or holdout(cfg),
        QUERIES,
        TRAIN,
        shingles(cfg.shingle_size),
        sign(cfg.shingle_size, cfg.num_perm),
    ]


def with_config(select: str, cfg: SearchConfig, extra: str = "") -> str:
    return f"""SELECT {cfg.query_divisor}::BIGINT AS query_divisor, {cfg.shingle_size}::BIGINT AS shingle_size,
  {cfg.num_perm}::BIGINT AS num_perm, {cfg.threshold}::DOUBLE AS threshold, {cfg.n_results}::BIGINT AS n_results,
  {extra} * FROM ({select})"""


def query_sizes(cfg: SearchConfig) -> str:
    return f"""sizes AS (SELECT doc_id AS query_id, count(*) AS n_shingles, sum(strlen(g))::BIGINT AS shingle_bytes,
  {8 * cfg.num_perm}::BIGINT AS sig_bytes FROM sh JOIN queries ON doc_id = query_id GROUP BY doc_id)"""


# ---- keywords ----


# The stopwords of each language, held here apart from the library's.
STOP = {
    "en": """a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which who will with you""",
    "de": """aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so um und von vor war wie wird zu zum""",
    "fr": """au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses son sont sur un une vous""",
    "es": """al como con de del el en entre era es esta este fue ha la las lo los más me no nos o para pero por que se si sin sobre su sus un una y ya""",
}


def keyword_tables(m: int, limit_name: str = "kw", lang: bool = True) -> list[str]:
    quoted = lambda text: ", ".join(f"'{w}'" for w in text.split())
    cases = " ".join(f"WHEN '{name}' THEN term NOT IN ({quoted(text)})" for name, text in STOP.items())
    any_list = f"term NOT IN ({quoted(' '.join(STOP.values()))})"
    content = f"CASE lang {cases} ELSE {any_list} END" if lang else any_list
    spoken = "grouped LEFT JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)" if lang else "grouped"
    # DuckDB counts edited bytes: the accented letters of the lower-case keywords become one byte.
    one_byte = "translate({}.keyword, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"
    similar = f"""1.0::DOUBLE - levenshtein({one_byte.format('y')}, {one_byte.format('x')}) / greatest(len(y.keyword), len(x.keyword))::DOUBLE
    > {DUPLICATE_LIMIT}::DOUBLE"""
    return [
        f"full_text AS (SELECT doc_id, title || ', ' || {clean()} AS full_text FROM corpus WHERE text IS NOT NULL)",
        f"""sentences AS (SELECT doc_id, unnest(list_transform(l, lambda x, i: {{'sentence': i - 1, 'body': x}}),
  recursive := true) FROM (SELECT doc_id, regexp_split_to_array(full_text, '{SENTENCE_END}') AS l FROM full_text))""",
        f"""chunks AS (SELECT doc_id, sentence, unnest(list_transform(l, lambda x, i: {{'chunk': i - 1, 'body': x}}),
  recursive := true) FROM (SELECT doc_id, sentence, regexp_split_to_array(body, '{CHUNK_END}') AS l FROM sentences))""",
        """word_lists AS (SELECT doc_id, sentence, chunk, list_filter(string_split(body, ' '), lambda w: w <> '') AS l
  FROM chunks)""",
        """words AS (SELECT doc_id, sentence, chunk, i - 1 AS pos, l[i] AS word, lower(l[i]) AS term,
  CASE WHEN i > 1 THEN lower(l[i - 1]) END AS lft, CASE WHEN i < len(l) THEN lower(l[i + 1]) END AS rgt
  FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM word_lists WHERE len(l) > 0))""",
        """grouped AS (SELECT doc_id, term, count(*) AS tf,
  count(*) FILTER (length(word) > 1 AND upper(word) = word AND lower(word) <> word) AS tf_acronym,
  count(*) FILTER (upper(substr(word, 1, 1)) = substr(word, 1, 1) AND lower(substr(word, 1, 1)) <> substr(word, 1, 1)
    AND (pos > 0 OR chunk > 0)) AS tf_proper,
  median(sentence)::DOUBLE AS median_sentence, count(DISTINCT lft) AS n_left, count(lft) AS all_left,
  count(DISTINCT rgt) AS n_right, count(rgt) AS all_right, count(DISTINCT sentence) AS n_sentences,
  max(sentence) AS last_sentence FROM words GROUP BY doc_id, term)""",
        f"""stats AS (SELECT *, {content} AS is_content, max(tf) OVER d AS max_tf,
  max(last_sentence) OVER d + 1 AS doc_sentences FROM {spoken} WINDOW d AS (PARTITION BY doc_id))""",
        """scaled AS (SELECT s.*, CASE WHEN is_content THEN tf_scale END AS tf_scale FROM stats s
  LEFT JOIN (SELECT doc_id, (sum(tf) + sqrt((count(*) * sum(tf * tf) - sum(tf) * sum(tf))::DOUBLE)) / count(*) AS tf_scale
    FROM stats WHERE is_content GROUP BY doc_id) USING (doc_id))""",
        """related AS (SELECT *, 1 + (coalesce(n_left::DOUBLE / nullif(all_left, 0), 0)
  + coalesce(n_right::DOUBLE / nullif(all_right, 0), 0)) * tf / max_tf AS rel FROM scaled)""",
        """terms AS (SELECT *, rel * ln(ln(3 + median_sentence)) / (greatest(tf_acronym, tf_proper) / (1 + ln(tf))
  + (tf / tf_scale) / rel + (n_sentences::DOUBLE / doc_sentences) / rel) AS score FROM related)""",
        """places AS (SELECT w.doc_id, sentence, chunk, pos, term, score FROM words w JOIN terms USING (doc_id, term)
  WHERE is_content)""",
        """runs AS (
  SELECT doc_id, term AS keyword, score AS product, 1 + score AS total FROM places
  UNION ALL SELECT a.doc_id, a.term || ' ' || b.term, a.score * b.score, 1 + (a.score + b.score) FROM places a
  JOIN places b ON a.doc_id = b.doc_id AND a.sentence = b.sentence AND a.chunk = b.chunk AND b.pos = a.pos + 1
  UNION ALL SELECT a.doc_id, a.term || ' ' || b.term || ' ' || c.term, a.score * b.score * c.score,
    1 + (a.score + b.score + c.score) FROM places a
  JOIN places b ON a.doc_id = b.doc_id AND a.sentence = b.sentence AND a.chunk = b.chunk AND b.pos = a.pos + 1
  JOIN places c ON a.doc_id = c.doc_id AND a.sentence = c.sentence AND a.chunk = c.chunk AND c.pos = a.pos + 2)""",
        """scored AS (SELECT doc_id, keyword, round(max(product) / (count(*) * max(total)), 10) AS score FROM runs
  GROUP BY doc_id, keyword)""",
        f"""taken AS (SELECT doc_id, list_reduce(
  list({{'score': score, 'keyword': keyword}} ORDER BY score, keyword),
  lambda acc, x: CASE WHEN len(acc) >= {m} THEN acc
    WHEN len(list_filter(acc, lambda y: {similar})) > 0 THEN acc ELSE list_append(acc, x) END,
  []::STRUCT(score DOUBLE, keyword VARCHAR)[]) AS keywords FROM scored GROUP BY doc_id)""",
        f"""{limit_name} AS (SELECT doc_id, i AS rank, keywords[i].keyword AS keyword, keywords[i].score AS score
  FROM (SELECT *, unnest(generate_series(1, len(keywords))) AS i FROM taken))""",
    ]


def keyword_sign(m: int, num_perm: int, name: str = "kw_sig") -> str:
    ids = f"""(SELECT doc_id, (('0x' || substr(md5(keyword), 1, 15))::BIGINT & {PRIME}) AS h FROM kw
  WHERE rank <= {m})"""
    return f"""{sign_ids(ids, num_perm, name + '_found')},
{name} AS (SELECT doc_id, coalesce(sig, list_transform(range({num_perm}), lambda x: {PRIME}::BIGINT)) AS sig
  FROM corpus LEFT JOIN {name}_found USING (doc_id))"""


def readable_keyword_sign(m: int, num_perm: int, name: str = "kw_sig") -> str:
    """Keyword signatures of the documents that have a text signature too."""
    return f"""{keyword_sign(m, num_perm, name + '_all')},
{name} AS (SELECT * FROM {name}_all WHERE doc_id IN (SELECT doc_id FROM sh_n))"""


def keyword_corpus(cfg: SearchConfig) -> list[str]:
    return [*corpus_of(cfg), *keyword_tables(cfg.n_keywords), readable_keyword_sign(cfg.n_keywords, cfg.num_perm)]


# ---- title search ----


def title_search(n: int) -> list[str]:
    def split(column: str) -> str:
        return f"list_filter(regexp_split_to_array(lower({column}), '{WORD_GAP}'), lambda w: w <> '')"

    return [
        f"""postings AS (SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest({split('s')}) AS term FROM roles WHERE is_train) GROUP BY doc_id, term)""",
        """idf AS (SELECT term, ln((SELECT count(*) FROM train)::DOUBLE / count(*)) AS idf FROM postings GROUP BY term)""",
        f"""asked AS (SELECT DISTINCT doc_id AS query_id, term FROM (
  SELECT doc_id, unnest({split('title')}) AS term FROM roles WHERE is_query))""",
        """ext_pairs AS (SELECT query_id, p.doc_id, train.pos, count(*) AS shared, round(sum(tf * idf), 9) AS score
  FROM asked JOIN idf USING (term) JOIN postings p USING (term) JOIN train ON train.doc_id = p.doc_id
  GROUP BY query_id, p.doc_id, train.pos)""",
        top("ext_pairs", "ext_top", n),
    ]


# ---- pairs of raw signatures ----


def raw_signatures() -> list[str]:
    return [DOCUMENTS, RAW, shingles(METRICS.shingle_size), sign(METRICS.shingle_size, METRICS.num_perm)]


def raw_readable() -> list[str]:
    """Ids with a raw signature, without computing it."""
    return [DOCUMENTS, f"sig AS (SELECT doc_id FROM corpus WHERE length(text) >= {METRICS.shingle_size})"]


def consecutive(seeds: str = "(SELECT 42::BIGINT AS repetition)") -> str:
    return f"""ordered AS (SELECT repetition, doc_id,
  row_number() OVER (PARTITION BY repetition ORDER BY {order_key('repetition')}, doc_id) AS pos,
  count(*) OVER (PARTITION BY repetition) AS n FROM (SELECT doc_id FROM sig), {seeds}),
pairs AS (SELECT a.repetition, a.pos, a.doc_id AS a_doc_id, b.doc_id AS b_doc_id FROM ordered a
  JOIN ordered b ON a.repetition = b.repetition AND b.pos = a.pos + 1 WHERE a.pos <= a.n - 2)"""


METRIC_PAIRS = f"""metrics AS (SELECT repetition, pos, a_doc_id, b_doc_id, {same('a.sig', 'b.sig')}::DOUBLE / len(a.sig) AS jaccard,
  array_to_string(list_transform(list_zip(a.sig, b.sig), lambda x: xor(x[1], x[2])), ',') AS xor,
  list_cosine_distance(a.sig::DOUBLE[], b.sig::DOUBLE[]) AS cosine,
  (len(a.sig) - {same('a.sig', 'b.sig')})::DOUBLE / len(a.sig) AS hamming,
  list_distance(a.sig::DOUBLE[], b.sig::DOUBLE[]) AS euclidean
  FROM pairs JOIN sig a ON a.doc_id = a_doc_id JOIN sig b ON b.doc_id = b_doc_id)"""


def pair_counts() -> list[str]:
    return [
        *raw_readable(),
        RAW,
        shingles(METRICS.shingle_size),
        consecutive(),
        """counted AS (SELECT pos, a_doc_id, b_doc_id, na.n AS n_a, nb.n AS n_b, (SELECT count(*) FROM sh x JOIN sh y
  ON x.g = y.g WHERE x.doc_id = a_doc_id AND y.doc_id = b_doc_id) AS shared FROM pairs
  JOIN sh_n na ON na.doc_id = a_doc_id JOIN sh_n nb ON nb.doc_id = b_doc_id)""",
    ]


PCT = """CASE WHEN jaccard = estimate THEN 100.0::DOUBLE WHEN estimate = 0 THEN 0.0::DOUBLE
  ELSE abs(jaccard - estimate) / estimate * 100.0::DOUBLE END"""


def sample(seed: int, name: str) -> str:
    return f"{name} AS (SELECT doc_id, text AS s FROM corpus ORDER BY {order_key(repr(str(seed)))}, doc_id LIMIT {SAMPLE})"


SAMPLES = [sample(1, "first_sample"), sample(2, "second_sample")]
BOTH = "both_samples AS (SELECT * FROM first_sample UNION SELECT * FROM second_sample)"
SAMPLE_PAIRS = """pairs AS (SELECT a.doc_id AS a_doc_id, b.doc_id AS b_doc_id FROM first_sample a
  JOIN second_sample b ON a.doc_id <> b.doc_id)"""


def accuracy_rows(k: int, num_perm: int, sh: str, sig: str, name: str) -> str:
    return f"""{name} AS (SELECT *, {PCT} AS pct_diff FROM (
  SELECT {k}::BIGINT AS k, {num_perm}::BIGINT AS num_perm, a_doc_id, b_doc_id,
    coalesce(shared, 0)::DOUBLE / (na.n + nb.n - coalesce(shared, 0)) AS jaccard,
    {same(f'sa.sig[1:{num_perm}]', f'sb.sig[1:{num_perm}]')}::DOUBLE / {num_perm} AS estimate
  FROM pairs JOIN {sh}_n na ON na.doc_id = a_doc_id JOIN {sh}_n nb ON nb.doc_id = b_doc_id
  JOIN {sig} sa ON sa.doc_id = a_doc_id JOIN {sig} sb ON sb.doc_id = b_doc_id
  LEFT JOIN (SELECT x.doc_id AS xa, y.doc_id AS yb, count(*) AS shared FROM {sh} x JOIN {sh} y ON x.g = y.g
    GROUP BY ALL) ON xa = a_doc_id AND yb = b_doc_id))"""


def self_rows(num_perm: int) -> list[str]:
    k = METRICS.shingle_size
    return [
        DOCUMENTS,
        placed(),
        f"sampled AS (SELECT doc_id, text AS s FROM placed WHERE pos <= floor(n_docs * {FRACTION}::DOUBLE))",
        shingles(k, source="sampled"),
        sign(k, num_perm),
        "pairs AS (SELECT a.doc_id AS a_doc_id, b.doc_id AS b_doc_id FROM sampled a JOIN sampled b ON a.doc_id <> b.doc_id)",
        accuracy_rows(k, num_perm, "sh", "sig", "rows"),
    ]


# ---- sweeps ----


def size_cells(sizes: tuple[int, ...], cfg: SearchConfig) -> str:
    """Roles per content size; all relations below carry the size."""
    rows = ", ".join(f"({s})" for s in sizes)
    return f"""cells AS (SELECT content_size::BIGINT AS content_size, least(content_size, count(*)) AS n_docs
  FROM corpus, (VALUES {rows}) v(content_size) GROUP BY content_size),
cell_docs AS (SELECT c.content_size, c.n_docs, doc_id, pos, pos <= c.n_docs - c.n_docs // {cfg.query_divisor} AS is_train
  FROM placed, cells c WHERE pos <= c.n_docs),
cell_queries AS (SELECT content_size, doc_id AS query_id FROM cell_docs WHERE NOT is_train),
cell_train AS (SELECT content_size, doc_id, pos FROM cell_docs WHERE is_train)"""


def cell_exact(n: int) -> list[str]:
    return [
        """asked AS (SELECT DISTINCT query_id FROM cell_queries)""",
        """shared AS (SELECT query_id, t.doc_id, count(*) AS shared FROM sh q JOIN asked ON q.doc_id = query_id
  JOIN sh t ON q.g = t.g GROUP BY ALL)""",
        f"""exact_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_size, query_id
    ORDER BY score DESC, pos) AS rank FROM (
  SELECT c.content_size, c.query_id, t.doc_id, t.pos,
    coalesce(shared.shared, 0)::DOUBLE / (qn.n + tn.n - coalesce(shared.shared, 0)) AS score
  FROM cell_queries c JOIN sh_n qn ON qn.doc_id = c.query_id JOIN cell_train t ON t.content_size = c.content_size
  JOIN sh_n tn ON tn.doc_id = t.doc_id
  LEFT JOIN shared ON shared.query_id = c.query_id AND shared.doc_id = t.doc_id)) WHERE rank <= {n})""",
    ]


def cell_similar(sig: str, length: int, name: str, n: int) -> list[str]:
    """Top lists by signature per cell; the similarity of a pair is computed once."""
    return [
        f"""{name}_pairs AS (SELECT query_id, t.doc_id, {same(f'q.sig[1:{length}]', f't.sig[1:{length}]')}::DOUBLE / {length}
  AS score FROM asked JOIN {sig} q ON q.doc_id = query_id CROSS JOIN {sig} t)""",
        f"""{name}_top AS (SELECT * FROM (SELECT content_size, query_id, doc_id, row_number() OVER (
    PARTITION BY content_size, query_id ORDER BY score DESC, pos) AS rank
  FROM cell_queries JOIN cell_train USING (content_size) JOIN {name}_pairs USING (query_id, doc_id)) WHERE rank <= {n})""",
    ]


def cell_candidates(cfg: SearchConfig, name: str) -> list[str]:
    b, r = cfg.bands
    return [
        f"""{name}_bands AS (SELECT doc_id, band, sig[band * {r} + 1 : band * {r} + {r}] AS bucket FROM sig,
  range({b}) t(band))""",
        f"""{name}_found AS (SELECT DISTINCT q.doc_id AS query_id, t.doc_id FROM {name}_bands q JOIN asked ON q.doc_id = query_id
  JOIN {name}_bands t ON q.band = t.band AND q.bucket = t.bucket)""",
        f"""{name}_candidates AS (SELECT content_size, query_id, doc_id FROM {name}_found JOIN cell_queries USING (query_id)
  JOIN cell_train USING (content_size, doc_id))""",
    ]


def cell_overlap(name: str, listed: str, exact: str = "exact_top") -> str:
    return f"""{name} AS (SELECT l.content_size, l.query_id, count(e.doc_id)::DOUBLE / count(*) AS overlap FROM {listed} l
  LEFT JOIN {exact} e ON e.content_size = l.content_size AND e.query_id = l.query_id AND e.doc_id = l.doc_id
  GROUP BY l.content_size, l.query_id)"""


def sweep_size_perm() -> str:
    ctes = [*corpus_of(CFG), size_cells(SIZES, CFG), *cell_exact(CFG.n_results)]
    selects = []
    for p in (64, 32):
        ctes += cell_similar("sig", p, f"s{p}", CFG.n_results) + cell_candidates(CFG.with_(num_perm=p), f"l{p}")
        ctes += [cell_overlap(f"s{p}_o", f"s{p}_top"), cell_overlap(f"l{p}_o", f"l{p}_candidates")]
        selects.append(f"""SELECT count(*) AS n_queries, count(l.overlap) AS n_evaluated,
  floor(avg(sh_n.n))::BIGINT AS avg_n_shingles, round(avg(l.overlap), 9) AS avg_overlap_lsh,
  round(avg(CASE WHEN l.overlap IS NOT NULL THEN s.overlap END), 9) AS avg_overlap_sig, {p}::BIGINT AS num_perm,
  content_size, any_value(cells.n_docs)::BIGINT AS n_docs
  FROM cell_queries JOIN sh_n ON sh_n.doc_id = query_id JOIN cells USING (content_size)
  LEFT JOIN l{p}_o l USING (content_size, query_id) LEFT JOIN s{p}_o s USING (content_size, query_id)
  GROUP BY content_size""")
    return chain(*ctes) + " UNION ALL ".join(selects)


def sweep_keywords() -> str:
    cfg, n = KEYWORDS, max(TOPS)
    ctes = [*corpus_of(cfg), size_cells(KEYWORD_CONTENT, cfg), *cell_exact(n), *keyword_tables(max(KEYWORD_SIZES))]
    ctes += cell_similar("sig", cfg.num_perm, "s", n) + cell_candidates(cfg, "l")
    for m in KEYWORD_SIZES:
        ctes += [readable_keyword_sign(m, cfg.num_perm, f"kw{m}_sig"), *cell_similar(f"kw{m}_sig", cfg.num_perm, f"k{m}", n)]
    selects = []
    for top_n in TOPS:
        ctes += [
            f"e{top_n} AS (SELECT * FROM exact_top WHERE rank <= {top_n})",
            cell_overlap(f"lo{top_n}", "l_candidates", f"e{top_n}"),
            cell_overlap(f"so{top_n}", f"(SELECT * FROM s_top WHERE rank <= {top_n})", f"e{top_n}"),
        ]
        for m in KEYWORD_SIZES:
            ctes.append(cell_overlap(f"ko{m}_{top_n}", f"(SELECT * FROM k{m}_top WHERE rank <= {top_n})", f"e{top_n}"))
            selects.append(f"""SELECT count(*) AS n_evaluated, round(avg(l.overlap), 9) AS avg_overlap_lsh,
  round(avg(s.overlap), 9) AS avg_overlap_sig, round(avg(k.overlap), 9) AS avg_overlap_kw, {m}::BIGINT AS n_keywords,
  {top_n}::BIGINT AS n_results, content_size, any_value(cells.n_docs)::BIGINT AS n_docs
  FROM lo{top_n} l JOIN so{top_n} s USING (content_size, query_id) JOIN ko{m}_{top_n} k USING (content_size, query_id)
  JOIN cells USING (content_size) GROUP BY content_size""")
    return chain(*ctes) + " UNION ALL ".join(selects)


def whole_corpus(n: int) -> list[str]:
    cfg = WHOLE
    return [
        *corpus_of(cfg, PAGES, whole()),
        bands(cfg),
        CANDIDATES,
        exact_pairs(),
        top("exact_pairs", "exact_all", n),
        *title_search(n),
    ]


def sweep_topn() -> str:
    cfg, n = WHOLE, max(TOPS)
    ctes = whole_corpus(n) + [sig_pairs(), top("sig_pairs", "sig_top", n), *keyword_tables(cfg.n_keywords, lang=False)]
    ctes += [readable_keyword_sign(cfg.n_keywords, cfg.num_perm), sig_pairs("kw_sig", "kw_pairs"), top("kw_pairs", "kw_top", n)]
    selects = []
    for t in TOPS:
        parts = []
        for name, listed in (("lsh", "candidates"), ("sig", "sig_top"), ("kw", "kw_top"), ("ext", "ext_top")):
            rows = listed if name == "lsh" else f"(SELECT * FROM {listed} WHERE rank <= {t})"
            ctes.append(f"""{name}{t} AS (SELECT l.query_id, count(e.doc_id)::DOUBLE / count(*) AS {name} FROM {rows} l
  LEFT JOIN (SELECT * FROM exact_all WHERE rank <= {t}) e ON e.query_id = l.query_id AND e.doc_id = l.doc_id
  GROUP BY l.query_id)""")
            parts.append(f"{name}{t}")
        joined = parts[0] + "".join(f" JOIN {p} USING (query_id)" for p in parts[1:])
        means = ", ".join(f"round(avg({x}), 9) AS avg_overlap_{x}" for x in ("lsh", "sig", "kw", "ext"))
        selects.append(f"SELECT count(*) AS n_evaluated, {means}, {t}::BIGINT AS n_results FROM {joined}")
    return chain(*ctes) + " UNION ALL ".join(selects)


def whole_stats() -> str:
    cfg, n = WHOLE, WHOLE.n_results
    ctes = [*whole_corpus(n), "exact_top AS (SELECT * FROM exact_all)", sig_pairs(), top("sig_pairs", "sig_top", n)]
    ctes += [*keyword_tables(cfg.n_keywords, lang=False), readable_keyword_sign(cfg.n_keywords, cfg.num_perm)]
    ctes += [sig_pairs("kw_sig", "kw_pairs"), top("kw_pairs", "kw_top", n), LSH_EVAL, query_sizes(cfg)]
    ctes += [list_eval(name, f"{name}_top") for name in ("sig", "kw", "ext")]
    joined = "lsh_eval" + "".join(f" JOIN {t} USING (query_id)" for t in ("sig_eval", "kw_eval", "ext_eval", "sizes"))
    rows = f"""SELECT 'pages' AS dataset, e.*, title, {8 * cfg.num_perm}::BIGINT AS keyword_sig_bytes,
  (SELECT count(*) FROM train JOIN sh_n USING (doc_id)) AS n_compared
  FROM (SELECT * FROM {joined}) e JOIN corpus ON corpus.doc_id = e.query_id"""
    return chain(*ctes) + with_config(rows, cfg, f"{cfg.n_keywords}::BIGINT AS n_keywords,").replace(
        f"SELECT {cfg.query_divisor}::BIGINT AS query_divisor,", "SELECT"
    )


def sweep_accuracy() -> str:
    ctes, selects = [DOCUMENTS, *SAMPLES, BOTH, SAMPLE_PAIRS], []
    for k in SHINGLE_SIZES:
        ctes += [shingles(k, f"sh{k}", "both_samples"), sign(k, 256 if k == 6 else 128, f"sig{k}", f"sh{k}")]
    grid = [(6, p) for p in NUM_PERMS if p != 128] + [(k, 128) for k in SHINGLE_SIZES]
    for k, p in grid:
        ctes.append(accuracy_rows(k, p, f"sh{k}", f"sig{k}", f"rows_{k}_{p}"))
        selects.append(f"""SELECT k, num_perm, count(*) AS n_pairs, round(avg(pct_diff), 9) AS avg_pct_diff
  FROM rows_{k}_{p} GROUP BY k, num_perm""")
    return chain(*ctes) + " UNION ALL ".join(selects)


ARTICLES = f"""articles AS (SELECT page_id, split_part(regexp_extract(url, '.*://(.*)', 1), '?', 1) AS title FROM pages
  WHERE contains(url, '{MARKER}') AND contains(url, '://'))"""
PATHS = """paths AS (SELECT regexp_extract(url, '.*://(.*)', 1) AS title, min(page_id) AS page_id FROM pages
  WHERE url IS NOT NULL GROUP BY 1)"""
CRAWL = """crawl AS (SELECT 'documents/' || doc_id AS cid, lang AS ext FROM documents
  UNION ALL SELECT 'pages/' || page_id, regexp_extract(url, '/([a-z][a-z])/', 1) FROM pages
  UNION ALL SELECT 'conversations/' || conv_id || '/' || turn, role FROM conversations
  UNION ALL SELECT 'benchmark/' || item_id, 'txt' FROM benchmark)"""


def oracles() -> dict[str, str]:
    k, n = CFG.shingle_size, CFG.n_results
    base = corpus_of(CFG)
    exact = [*base, exact_pairs(), top("exact_pairs", "exact_top", n)]
    quality = [*exact, sig_pairs(), top("sig_pairs", "sig_top", n), bands(CFG), CANDIDATES, LSH_EVAL]
    quality += [list_eval("sig", "sig_top"), query_sizes(CFG)]
    no_sig = [DOCUMENTS, placed(), holdout(CFG), QUERIES, TRAIN, shingles(k), exact_pairs()]
    kw = keyword_corpus(KEYWORDS)
    kw_quality = [
        *kw,
        exact_pairs(),
        top("exact_pairs", "exact_top", n),
        sig_pairs(),
        top("sig_pairs", "sig_top", n),
        sig_pairs("kw_sig", "kw_pairs"),
        top("kw_pairs", "kw_top", n),
        bands(KEYWORDS),
        CANDIDATES,
        LSH_EVAL,
        list_eval("sig", "sig_top"),
        list_eval("kw", "kw_top"),
        query_sizes(KEYWORDS),
    ]
    keyword_stats = chain(*kw_quality) + with_config(
        "SELECT * FROM lsh_eval JOIN sig_eval USING (query_id) JOIN kw_eval USING (query_id) JOIN sizes USING (query_id)",
        KEYWORDS, f"{8 * KEYWORDS.num_perm}::BIGINT AS keyword_sig_bytes, {KEYWORDS.n_keywords}::BIGINT AS n_keywords,",
    )
    keyword_only = [DOCUMENTS, *keyword_tables(KEYWORDS.n_keywords)]
    metric = [*raw_signatures(), consecutive(), METRIC_PAIRS]
    pair = "pos, a_doc_id, b_doc_id"
    sample_rows = [DOCUMENTS, *SAMPLES, BOTH, SAMPLE_PAIRS, shingles(6, source="both_samples"), sign(6, 128)]
    sample_rows.append(accuracy_rows(6, 128, "sh", "sig", "rows"))
    profile = """SELECT query_id, count(*) AS n_pairs, count(*) FILTER (shared = 0) AS n_disjoint,
  sum(shared)::BIGINT AS sum_shared, max(score) AS max_score FROM {} GROUP BY query_id"""
    judged = f"""judged AS (SELECT doc_id, CASE WHEN text IS NULL THEN 'missing'
  WHEN length({clean()}) < {KEYWORDS.shingle_size} THEN 'short' END AS reason FROM documents)"""
    digest = "SELECT doc_id, count(*) AS n_shingles, md5(string_agg(g, chr(31) ORDER BY g)) AS digest FROM {} GROUP BY doc_id"
    upto = [DOCUMENTS, CLEAN, *[shingles(size, f"sh{size}") for size in range(1, k + 1)]]
    upto.append("sh AS (" + " UNION ALL ".join(f"SELECT * FROM sh{size}" for size in range(1, k + 1)) + ")")
    stats = "SELECT * FROM lsh_eval JOIN sig_eval USING (query_id) JOIN sizes USING (query_id)"
    query_stats = chain(*quality) + with_config(stats, CFG)
    overall = """SELECT count(*) AS n_queries, count(overlap_lsh) AS n_evaluated,
  floor(avg(shingle_bytes))::BIGINT AS avg_shingle_bytes, floor(avg(sig_bytes))::BIGINT AS avg_sig_bytes,
  round(avg(overlap_lsh), 9) AS avg_overlap_lsh,
  round(avg(CASE WHEN overlap_lsh IS NOT NULL THEN overlap_sig END), 9) AS avg_overlap_sig
  FROM sizes LEFT JOIN lsh_eval USING (query_id) LEFT JOIN sig_eval USING (query_id)"""
    global_stats = chain(*quality) + with_config(overall, CFG)
    metric_rows = f"SELECT {pair}, jaccard, xor, round(cosine, 9) AS cosine, hamming, round(euclidean, 3) AS euclidean FROM metrics"
    metric_summary = chain(
        *raw_signatures(), consecutive(f"(SELECT unnest(generate_series(1, {REPETITIONS})) AS repetition)"), METRIC_PAIRS
    ) + """SELECT repetition, count(*) AS n_pairs, round(avg(jaccard), 9) AS avg_jaccard,
  round(avg(cosine), 9) AS avg_cosine, round(avg(hamming), 9) AS avg_hamming, round(avg(euclidean), 2) AS avg_euclidean
  FROM metrics GROUP BY repetition"""
    doc_stats = f"""SELECT doc_id, n * {KEYWORDS.num_perm} AS full_cost, m * {KEYWORDS.num_perm} AS keyword_cost FROM sh_n
  JOIN (SELECT doc_id, count(*) AS m FROM kw GROUP BY doc_id) USING (doc_id)"""
    doc_costs = chain(*keyword_only, CLEAN, shingles(KEYWORDS.shingle_size))
    long_enough = f"doc_id IN (SELECT doc_id FROM roles WHERE length(s) >= {k})"
    all_sizes = " UNION ALL ".join(f"SELECT * FROM sh{size} WHERE {long_enough}" for size in range(1, k + 1))
    split_upto = [DOCUMENTS, placed(), holdout(CFG), QUERIES, TRAIN, *[shingles(size, f"sh{size}") for size in range(1, k + 1)]]
    split_upto += [f"sh AS ({all_sizes})", "sh_n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id)", exact_pairs()]
    accuracy = "SELECT k, num_perm, a_doc_id, b_doc_id, jaccard, estimate, pct_diff FROM rows"
    out = {
        "scan_articles": chain(ARTICLES) + "SELECT * FROM articles",
        "scan_kind_counts": f"""SELECT count(*) AS n_entries,
  count(*) FILTER (contains(url, '{MARKER}') AND contains(url, '://')) AS n_articles,
  count(*) FILTER (NOT contains(url, '{MARKER}')) AS n_other,
  count(*) FILTER (url IS NULL OR (contains(url, '{MARKER}') AND NOT contains(url, '://'))) AS n_failed FROM pages""",
        "index_links": """SELECT page_id, unnest(generate_series(1, len(l))) AS pos, unnest(l) AS title FROM (
  SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s).*</head>(.*)', 1), 'href="([^"]*)"', 1) AS l FROM pages)""",
        "lookup_content": chain(ARTICLES, PATHS) + """SELECT title, p.page_id, length(html) AS n_chars, md5(html) AS digest
  FROM (SELECT DISTINCT title FROM articles) JOIN paths USING (title) JOIN pages p ON p.page_id = paths.page_id""",
        "html_to_text": f"SELECT page_id, {page_text()} AS text FROM pages",
        "coverage": chain(ARTICLES, PATHS) + """SELECT count(*) AS n_titles, count(p.page_id) AS n_found,
  count(*) FILTER (p.page_id IS NULL) AS n_missing FROM articles LEFT JOIN paths p USING (title)""",
        "filter_crawl_ids": chain(CRAWL) + "SELECT cid FROM crawl WHERE ext = 'en'",
        "scan_limit": chain(CRAWL) + f"SELECT cid FROM crawl WHERE ext = 'en' ORDER BY cid LIMIT {ID_LIMIT}",
        # An empty type comes back from CSV as null.
        "union_frames": chain(CRAWL) + "SELECT ext, count(*) AS n_rows FROM crawl GROUP BY ext",
        "sink_query_stats": query_stats,
        "sink_global_stats": global_stats,
        "sink_accuracy": chain(*sample_rows) + f"SELECT {SAMPLE}::BIGINT AS n, * FROM ({accuracy})",
        "sink_metrics": chain(*metric) + metric_rows,
        "sink_doc_stats": doc_costs + doc_stats,
        "sink_signing_stats": doc_costs + with_config(
            f"SELECT d.*, doc_id::VARCHAR AS title FROM ({doc_stats}) d", KEYWORDS, f"{KEYWORDS.n_keywords}::BIGINT AS n_keywords,"
        ),
        "sink_corpus_stats": chain(DOCUMENTS, CLEAN, shingles(METRICS.shingle_size)) + f"""SELECT 'documents' AS dataset,
  (SELECT count(*) FROM corpus) AS n_titles, round(avg(n * {METRICS.num_perm}), 6) AS avg_cost FROM sh_n""",
        "sink_metric_means": f"SELECT 'documents' AS dataset, * FROM ({metric_summary})",
        "sink_keyword_stats": keyword_stats,
        "sink_whole_stats": whole_stats(),
        "normalize_ws": f"SELECT doc_id, {clean()} AS text FROM documents",
        "strip_prefix": "SELECT doc_id, replace('A/' || source || '/A/' || doc_id, 'A/', '') AS title FROM documents",
        "title_text": chain(DOCUMENTS) + f"SELECT doc_id, title || ', ' || {clean()} AS full_text FROM corpus",
        "title_case": chain(PAGES) + """SELECT doc_id, array_to_string(list_transform(string_split(title, ' '),
  lambda w: CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:])), ' ') AS title FROM corpus""",
        "underscore_title": chain(PAGES) + "SELECT doc_id, replace(title, ' ', '_') AS title FROM corpus",
        "drop_failed": chain(judged) + "SELECT doc_id, 'A/' || doc_id AS title FROM judged WHERE reason IS NULL",
        "reject_rows": chain(judged) + """SELECT count(*) AS n_requested, count(*) FILTER (reason IS NULL) AS n_kept,
  count(*) FILTER (reason = 'missing') AS n_missing, count(*) FILTER (reason = 'short') AS n_short FROM judged""",
        "pct_change": f"""SELECT doc_id, CASE WHEN n_chars = m THEN 100.0::DOUBLE WHEN m = 0 THEN 0.0::DOUBLE
  ELSE abs(n_chars - m)::DOUBLE / m * 100.0::DOUBLE END AS pct_change
  FROM (SELECT doc_id, n_chars, length({clean()}) AS m FROM documents)""",
        "sig_id": chain(*raw_signatures()) + "SELECT doc_id, sha256(array_to_string(sig, ',')) AS sig_id FROM sig",
        "sig_bytes": chain(*raw_signatures()) + "SELECT doc_id, len(sig) * 8 AS sig_bytes FROM sig",
        "shuffle_docs": chain(DOCUMENTS, placed()) + "SELECT doc_id, pos FROM placed",
        "limit_content": chain(DOCUMENTS, placed())
        + "SELECT doc_id, pos, least(n_docs, 500) AS n_docs FROM placed WHERE pos <= 500",
        "split_train_query": chain(DOCUMENTS, placed(), holdout(CFG)) + "SELECT doc_id, pos, is_query FROM roles",
        "split_full": chain(DOCUMENTS, placed()) + """SELECT doc_id, pos, 'train' AS role FROM placed
  UNION ALL SELECT doc_id, pos, 'query' FROM placed WHERE pos > 500""",
        "two_samples": " UNION ALL ".join(
            f"""SELECT {s}::BIGINT AS sample, pos, doc_id FROM (SELECT doc_id, row_number() OVER (
  ORDER BY {order_key(repr(str(s)))}, doc_id) AS pos FROM documents) WHERE pos <= {SAMPLE}"""
            for s in (1, 2)
        ),
        "sample_fraction": chain(DOCUMENTS, placed())
        + f"SELECT doc_id, pos FROM placed WHERE pos <= floor(n_docs * {FRACTION}::DOUBLE)",
        "shingle_set": chain(DOCUMENTS, CLEAN, shingles(k)) + digest.format("sh"),
        "shingle_set_upto": chain(*upto) + digest.format("sh")
        + f" HAVING doc_id IN (SELECT doc_id FROM roles WHERE length(s) >= {k})",
        "shingle_counts": chain(DOCUMENTS, CLEAN, shingles(k))
        + "SELECT doc_id, count(*) AS n_shingles, sum(strlen(g))::BIGINT AS shingle_bytes FROM sh GROUP BY doc_id",
        "minhash_signature": chain(DOCUMENTS, CLEAN, shingles(k), sign(k, CFG.num_perm))
        + "SELECT doc_id, array_to_string(sig, ',') AS sig FROM sig",
        "signature_batch": chain(DOCUMENTS, CLEAN, shingles(k)) + """SELECT (SELECT count(*) FROM corpus) AS n_docs,
  count(*) AS n_signed, round(avg(n), 9) AS avg_cost FROM sh_n""",
        "generate_sig": chain(DOCUMENTS, RAW, shingles(6), sign(6, 128)) + """SELECT doc_id, coalesce(n, 0) AS n_shingles,
  array_to_string(sig, ',') AS sig FROM corpus LEFT JOIN sh_n USING (doc_id) LEFT JOIN sig USING (doc_id)""",
        "keyword_terms": chain(*keyword_only) + """SELECT doc_id, term, tf, tf_acronym, tf_proper, median_sentence, n_left,
  all_left, n_right, all_right, n_sentences, round(score, 9) AS score FROM terms""",
        "keyword_extract": chain(*keyword_only) + "SELECT doc_id, rank, keyword, score FROM kw",
        "keyword_signature": chain(*keyword_only, keyword_sign(KEYWORDS.n_keywords, KEYWORDS.num_perm))
        + "SELECT doc_id, array_to_string(sig, ',') AS sig FROM kw_sig",
        "jaccard_exact": chain(*pair_counts())
        + f"SELECT {pair}, shared::DOUBLE / nullif(n_a + n_b - shared, 0) AS jaccard FROM counted",
        "set_intersection": chain(*pair_counts()) + f"SELECT {pair}, shared AS n_shared FROM counted",
        "set_union": chain(*pair_counts()) + f"SELECT {pair}, n_a + n_b - shared AS n_united FROM counted",
        "jaccard_estimate": chain(*metric) + f"SELECT {pair}, jaccard FROM metrics",
        "xor_distance": chain(*metric) + f"SELECT {pair}, xor FROM metrics",
        "cosine_distance": chain(*metric) + f"SELECT {pair}, round(cosine, 9) AS cosine FROM metrics",
        "hamming_distance": chain(*metric) + f"SELECT {pair}, hamming FROM metrics",
        "euclidean_distance": chain(*metric) + f"SELECT {pair}, round(euclidean, 3) AS euclidean FROM metrics",
        "pairs_consecutive": chain(*raw_readable(), consecutive()) + f"SELECT {pair} FROM pairs",
        "pairs_two_samples": chain(DOCUMENTS, *SAMPLES, SAMPLE_PAIRS) + "SELECT a_doc_id, b_doc_id FROM pairs",
        "pairs_self": chain(*self_rows(64)) + """SELECT a_doc_id AS doc_id, count(*) AS n_pairs,
  round(sum(pct_diff), 6) AS sum_pct_diff FROM rows GROUP BY a_doc_id""",
        "pairs_exact": chain(*no_sig) + profile.format("exact_pairs"),
        "pairs_signature": chain(*base, sig_pairs()) + profile.format("sig_pairs"),
        "pairs_keyword": chain(*kw, sig_pairs("kw_sig", "kw_pairs")) + profile.format("kw_pairs"),
        "lsh_index": chain(*base, bands(CFG)) + "SELECT doc_id, band, bucket FROM bands JOIN train USING (doc_id)",
        "lsh_candidates": chain(*base, bands(CFG), CANDIDATES) + """SELECT query_id, first_doc_id, count(*) AS n_docs FROM
  candidates JOIN (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sig ORDER BY pos) AS first_doc_id
    FROM sig JOIN train USING (doc_id)) USING (doc_id) GROUP BY query_id, first_doc_id""",
        "lsh_documents": chain(*base, bands(CFG), CANDIDATES) + "SELECT query_id, doc_id FROM candidates",
        "lsh_append": chain(*base, bands(CFG), CANDIDATES) + "SELECT query_id, count(*) AS n_candidates FROM candidates GROUP BY query_id",
        "topk_exact": chain(*no_sig, top("exact_pairs", "exact_top", n)) + "SELECT * FROM exact_top",
        "topk_upto": chain(*split_upto, top("exact_pairs", "exact_top", n)) + "SELECT * FROM exact_top",
        "topk_signature": chain(*base, sig_pairs(), top("sig_pairs", "sig_top", n)) + "SELECT * FROM sig_top",
        "topk_keyword": chain(*kw, sig_pairs("kw_sig", "kw_pairs"), top("kw_pairs", "kw_top", n)) + "SELECT * FROM kw_top",
        "external_results": chain(PAGES, placed(), whole(), TRAIN, *title_search(WHOLE.n_results))
        + """SELECT query_id, rank, e.doc_id, replace(title, ' ', '_') AS title, shared, score FROM ext_top e
  JOIN corpus ON corpus.doc_id = e.doc_id""",
        "external_without_first": chain(PAGES, placed(), whole(), TRAIN, *title_search(WHOLE.n_results + 1))
        + "SELECT query_id, rank - 1 AS rank, doc_id, shared, score FROM ext_top WHERE rank > 1",
        "result_overlap": chain(*quality) + "SELECT e.query_id, e.doc_id FROM exact_top e JOIN sig_top USING (query_id, doc_id)",
        "recall_lsh": chain(*exact, bands(CFG), CANDIDATES, LSH_EVAL) + "SELECT * FROM lsh_eval",
        "recall_signature": chain(*quality) + "SELECT sig_eval.* FROM sig_eval JOIN lsh_counts USING (query_id)",
        "recall_keyword": chain(*kw_quality) + "SELECT kw_eval.* FROM kw_eval JOIN lsh_counts USING (query_id)",
        "recall_external": chain(
            PAGES, placed(), whole(), QUERIES, TRAIN, shingles(WHOLE.shingle_size), exact_pairs(),
            top("exact_pairs", "exact_top", WHOLE.n_results), *title_search(WHOLE.n_results), list_eval("ext", "ext_top"),
        ) + "SELECT * FROM ext_eval",
        "query_stats": query_stats,
        "keyword_stats": keyword_stats,
        "whole_stats": whole_stats(),
        "global_stats": global_stats,
        "accuracy_avg": chain(*self_rows(64))
        + "SELECT count(*) AS n_pairs, round(sum(pct_diff) / count(*), 9) AS avg_pct_diff FROM rows",
        "metric_summary": metric_summary,
        "error_counts": chain(*base, bands(CFG), CANDIDATES) + f"""SELECT count(*) AS n_queries,
  count(*) FILTER (length(s) < {k}) AS n_unreadable,
  count(*) FILTER (length(s) >= {k} AND doc_id NOT IN (SELECT query_id FROM candidates)) AS n_without_candidates,
  count(*) FILTER (length(s) >= {k} AND doc_id IN (SELECT query_id FROM candidates)) AS n_evaluated
  FROM roles WHERE is_query""",
        "error_stages": chain(*kw, bands(KEYWORDS), CANDIDATES) + f"""SELECT stage, count(*) AS n_queries FROM (SELECT CASE
  WHEN text IS NULL THEN 'missing' WHEN length(s) < {KEYWORDS.shingle_size} THEN 'short'
  WHEN doc_id NOT IN (SELECT doc_id FROM kw) THEN 'keywords'
  WHEN doc_id NOT IN (SELECT query_id FROM candidates) THEN 'candidates' ELSE 'evaluated' END AS stage
  FROM roles WHERE is_query) GROUP BY stage""",
        "index_coverage": chain(DOCUMENTS, placed(), holdout(CFG)) + f"""SELECT count(*) AS n_requested,
  count(*) FILTER (length(s) >= {k}) AS n_indexed FROM roles WHERE is_train""",
        "footprint": chain(DOCUMENTS, CLEAN, shingles(6)) + """SELECT doc_id, sum(strlen(g))::BIGINT AS shingle_bytes,
  1024::BIGINT AS sig_bytes, 1024::BIGINT AS keyword_sig_bytes FROM sh GROUP BY doc_id""",
        "sweep_size_perm": sweep_size_perm(),
        "sweep_keywords": sweep_keywords(),
        "sweep_topn": sweep_topn(),
        "sweep_accuracy": sweep_accuracy(),
    }
    # A sink holds the rows of both runs.
    runs = "(VALUES ('first'), ('second')) AS runs(run)"
    return {name: f"SELECT * FROM ({q}) AS r, {runs}" if name.startswith("sink_") else q for name, q in out.items()}
