"""One query per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from akin.config import SearchConfig
from akin.functions import distances, signature, text
from akin.operators import keywords, lsh, ordering, rejects
from akin.operators.blocks import profile
from akin.operators.evaluate import candidate_flags, candidate_overlap, list_overlap, result_overlap
from akin.operators.postings import posting_profile, posting_top
from akin.operators.skew import sliced_join
from akin.plans import accuracy, corpus, keyword_quality, quality
from akin.session import fresh_path, materialise
from akin.sources import articles, crawl, sinks

CFG = SearchConfig()
KEYWORDS = SearchConfig(shingle_size=6, num_perm=128)
METRICS = SearchConfig(shingle_size=4, num_perm=128, threshold=0.45)
WHOLE = KEYWORDS
WHOLE_SKIP = 25
MARKER = ".example.com/"
SIZES = (100, 500, 1000, 1500, 2000, 5000, 10000)
KEYWORD_CONTENT = (500, 1000, 2000, 5000)
KEYWORD_SIZES = (15, 25, 35)
TOPS = (3, 5, 7)
SAMPLE = 50
FRACTION = 0.1
ID_LIMIT = 100
NUM_PERMS = (4, 8, 16, 32, 64, 128, 256)
SHINGLE_SIZES = (2, 4, 6, 8, 10, 12)
REPETITIONS = 20
RUNS = ("first", "second")

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with their language, which chooses the stopwords."""
    # The given files are single row groups, which the reader cannot split: deal their rows to all cores. The
    # library itself takes tables as they are scanned.
    docs = table(spark, sf_dir, "documents").repartition("doc_id")
    return docs.select("doc_id", F.concat(F.lit("A/"), F.col("doc_id").cast("string")).alias("title"), "text", "lang")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoken(spark, sf_dir).drop("lang")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").repartition("page_id")


def whole_split(spark: SparkSession, sf_dir: str) -> tuple[corpus.Split, DataFrame]:
    # The pages are parsed once; the text is a fraction of the markup.
    docs = materialise(articles.page_documents(pages(spark, sf_dir)), "page-texts")
    return corpus.whole(docs, WHOLE, WHOLE_SKIP), docs


def run_of(spark: SparkSession, sf_dir: str, cfg: SearchConfig = CFG) -> corpus.Split:
    return corpus.holdout(documents(spark, sf_dir), cfg)


# ---- sources and sinks ----


@query
def scan_articles(spark, sf_dir):
    return articles.scan_articles(pages(spark, sf_dir), MARKER)


@query
def scan_kind_counts(spark, sf_dir):
    return articles.kind_counts(pages(spark, sf_dir), MARKER)


@query
def index_links(spark, sf_dir):
    return articles.index_links(pages(spark, sf_dir))


@query
def lookup_content(spark, sf_dir):
    entries = pages(spark, sf_dir)
    found = articles.lookup_content(articles.scan_articles(entries, MARKER), entries)
    return found.select("title", "page_id", F.length("html").cast("long").alias("n_chars"), F.md5("html").alias("digest"))


@query
def html_to_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query
def coverage(spark, sf_dir):
    entries = pages(spark, sf_dir)
    return articles.coverage(articles.scan_articles(entries, MARKER), entries)


def crawl_frames(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Four crawl lists: the four text tables, with the language or role as type."""

    def frame(name: str, ids: list[str], ext) -> DataFrame:
        cid = F.concat_ws("/", F.lit(name), *ids)
        return table(spark, sf_dir, name).select(cid.alias("cid"), ext.alias("ext"))

    return [
        frame("documents", ["doc_id"], F.col("lang")),
        frame("pages", ["page_id"], F.regexp_extract("url", "/([a-z][a-z])/", 1)),
        frame("conversations", ["conv_id", "turn"], F.col("role")),
        frame("benchmark", ["item_id"], F.lit("txt")),
    ]


def crawl_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [crawl.write_crawl_list(f, fresh_path(spark, "crawl")) for f in crawl_frames(spark, sf_dir)]
    return crawl.read_crawl_lists(spark, lists)


def id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "ids")
    crawl.append_ids(crawl.filter_crawl_ids(crawl_table(spark, sf_dir), "en"), path)
    return crawl.read_ids(spark, path)


@query
def filter_crawl_ids(spark, sf_dir):
    return id_list(spark, sf_dir)


@query
def scan_limit(spark, sf_dir):
    return crawl.scan_limit(id_list(spark, sf_dir), ID_LIMIT)


@query
def union_frames(spark, sf_dir):
    frames = crawl.union_frames(crawl_frames(spark, sf_dir))
    return frames.groupBy("ext").agg(F.count(F.lit(1)).alias("n_rows"))


def through_sink(rows: DataFrame, name: str) -> DataFrame:
    """Append the rows as two runs and read the table back: every row once for each ``run``."""
    spark, path = rows.sparkSession, fresh_path(rows.sparkSession, name)
    rows = materialise(rows, f"{name}-rows")
    for run in RUNS:
        sinks.append_rows(rows, path, run)
    return sinks.read_rows(spark, path, rows)


@query
def sink_query_stats(spark, sf_dir):
    return through_sink(query_stats(spark, sf_dir), "query-stats")


@query
def sink_global_stats(spark, sf_dir):
    return through_sink(global_stats(spark, sf_dir), "global-stats")


@query
def sink_accuracy(spark, sf_dir):
    pairs = accuracy.sample_accuracy(documents(spark, sf_dir), SAMPLE, (6,), 128)
    rows = accuracy.pair_accuracy(pairs, 128)
    return through_sink(rows.select(F.lit(SAMPLE).cast("long").alias("n"), "*"), "accuracy")


@query
def sink_metrics(spark, sf_dir):
    return through_sink(distance_metrics(spark, sf_dir), "metrics")


def signing_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and keywords that go into the signatures of every document, times the permutations."""
    cfg = KEYWORDS
    docs = spoken(spark, sf_dir)
    counts = counted(spark, sf_dir, cfg.shingle_size)
    found = materialise(keywords.extract_keywords(keyword_quality.keyword_input(docs), cfg.n_keywords), "keywords")
    return counts.join(found.filter("keywords is not null"), "doc_id").select(
        "doc_id",
        (F.col("n_shingles") * cfg.num_perm).alias("full_cost"),
        (F.size("keywords").cast("long") * cfg.num_perm).alias("keyword_cost"),
    )


@query
def sink_doc_stats(spark, sf_dir):
    return through_sink(signing_costs(spark, sf_dir), "doc-stats")


@query
def sink_signing_stats(spark, sf_dir):
    titles = documents(spark, sf_dir).select("doc_id", text.strip_prefix(F.col("title")).alias("title"))
    rows = signing_costs(spark, sf_dir).join(titles, "doc_id")
    number = F.lit(KEYWORDS.n_keywords).cast("long").alias("n_keywords")
    return through_sink(with_config(rows, KEYWORDS).select("*", number), "signing-stats")


@query
def sink_corpus_stats(spark, sf_dir):
    rows = clean_signatures(spark, sf_dir, METRICS).agg(
        F.lit("documents").alias("dataset"),
        F.count(F.lit(1)).alias("n_titles"),
        F.round(F.avg(F.when(F.col("n_shingles") > 0, F.col("n_shingles") * METRICS.num_perm)), 6).alias("avg_cost"),
    )
    return through_sink(rows, "corpus-stats")


@query
def sink_metric_means(spark, sf_dir):
    rows = metric_summary(spark, sf_dir).select(F.lit("documents").alias("dataset"), "*")
    return through_sink(rows, "metric-means")


@query
def sink_keyword_stats(spark, sf_dir):
    return through_sink(keyword_stats(spark, sf_dir), "keyword-stats")


@query
def sink_whole_stats(spark, sf_dir):
    return through_sink(whole_stats(spark, sf_dir), "whole-stats")


# ---- projections and filters ----


@query
def normalize_ws(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.normalise(F.col("text")).alias("text"))


@query
def strip_prefix(spark, sf_dir):
    title = F.concat(F.lit("A/"), F.col("source"), F.lit("/A/"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_prefix(title).alias("title"))


@query
def title_text(spark, sf_dir):
    return keyword_quality.keyword_input(documents(spark, sf_dir)).select("doc_id", "full_text")


@query
def title_case(spark, sf_dir):
    docs = articles.page_documents(pages(spark, sf_dir))
    return docs.select("doc_id", text.title_case(F.col("title")).alias("title"))


@query
def underscore_title(spark, sf_dir):
    docs = articles.page_documents(pages(spark, sf_dir))
    return docs.select("doc_id", text.underscore(F.col("title")).alias("title"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("text", text.normalise(F.col("text")))
    return rejects.reject_rows(docs, KEYWORDS.shingle_size)


@query
def drop_failed(spark, sf_dir):
    return rejects.drop_failed(judged(spark, sf_dir)).select("doc_id", "title")


@query
def reject_rows(spark, sf_dir):
    return rejects.reject_counts(judged(spark, sf_dir))


@query
def pct_change(spark, sf_dir):
    clean = F.length(text.normalise(F.col("text"))).cast("double")
    change = distances.pct_change(F.col("n_chars").cast("double"), clean)
    return table(spark, sf_dir, "documents").select("doc_id", change.alias("pct_change"))


def raw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.raw_signatures(documents(spark, sf_dir), METRICS.shingle_size, METRICS.num_perm)


@query
def sig_id(spark, sf_dir):
    return raw_table(spark, sf_dir).select("doc_id", "sig_id")


@query
def sig_bytes(spark, sf_dir):
    return raw_table(spark, sf_dir).select("doc_id", signature.sig_bytes(F.col("sig")).alias("sig_bytes"))


# ---- ordering and sampling ----


def placed(spark: SparkSession, sf_dir: str, seed: int = CFG.seed) -> DataFrame:
    return ordering.shuffled(table(spark, sf_dir, "documents").select("doc_id"), seed=seed)


@query
def shuffle_docs(spark, sf_dir):
    return placed(spark, sf_dir).select("doc_id", "pos")


@query
def limit_content(spark, sf_dir):
    return ordering.limit_content(placed(spark, sf_dir), 500).select("doc_id", "pos", "n_docs")


@query
def split_train_query(spark, sf_dir):
    return ordering.with_role(placed(spark, sf_dir), CFG.query_divisor).select("doc_id", "pos", "is_query")


@query
def split_full(spark, sf_dir):
    train, asked = ordering.split_full(placed(spark, sf_dir), 500)
    both = train.withColumn("role", F.lit("train")).unionByName(asked.withColumn("role", F.lit("query")))
    return both.select("doc_id", "pos", "role")


@query
def two_samples(spark, sf_dir):
    samples = ordering.two_samples(table(spark, sf_dir, "documents").select("doc_id"), SAMPLE)
    parts = [s.select(F.lit(i).cast("long").alias("sample"), "pos", "doc_id") for i, s in enumerate(samples, 1)]
    return parts[0].unionByName(parts[1])


@query
def sample_fraction(spark, sf_dir):
    return ordering.sample_first(placed(spark, sf_dir), FRACTION).select("doc_id", "pos")


# ---- shingles, signatures, keywords ----


def shingle_digest(spark: SparkSession, sf_dir: str, k: int, mode: str = "exact") -> DataFrame:
    """The whole set of each document, told by its size and a digest of its sorted members."""
    clean = text.normalise(F.col("text"))
    summary = text.let(
        text.shingle_strings(clean, k, mode),
        lambda s: F.struct(
            F.size(s).cast("long").alias("n_shingles"),
            F.md5(F.array_join(F.sort_array(s), "\x1f")).alias("digest"),
        ),
    )
    docs = documents(spark, sf_dir).filter(F.length(clean) >= k)
    return docs.select("doc_id", summary.alias("summary")).select("doc_id", "summary.*")


@query
def shingle_set(spark, sf_dir):
    return shingle_digest(spark, sf_dir, CFG.shingle_size)


@query
def shingle_set_upto(spark, sf_dir):
    return shingle_digest(spark, sf_dir, CFG.shingle_size, "upto")


def counted(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    clean = text.normalise(F.col("text"))
    docs = documents(spark, sf_dir).filter(F.length(clean) >= k)
    return docs.select("doc_id", text.shingle_counts(clean, k).alias("counts")).select("doc_id", "counts.*")


@query
def shingle_counts(spark, sf_dir):
    return counted(spark, sf_dir, CFG.shingle_size)


def clean_signatures(spark: SparkSession, sf_dir: str, cfg: SearchConfig) -> DataFrame:
    docs = documents(spark, sf_dir)
    signed = signature.text_signature(text.normalise(F.col("text")), cfg.shingle_size, cfg.num_perm)
    return docs.select("doc_id", signed.alias("signed")).select("doc_id", "signed.n_shingles", "signed.sig")


@query
def minhash_signature(spark, sf_dir):
    rows = materialise(clean_signatures(spark, sf_dir, CFG), "signatures").filter("n_shingles > 0")
    return rows.select("doc_id", signature.joined(F.col("sig")).alias("sig"))


@query
def signature_batch(spark, sf_dir):
    rows = clean_signatures(spark, sf_dir, METRICS)
    return rows.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count("sig").alias("n_signed"),
        F.round(F.avg(F.when(F.col("n_shingles") > 0, F.col("n_shingles"))), 9).alias("avg_cost"),
    )


@query
def generate_sig(spark, sf_dir):
    docs = documents(spark, sf_dir)
    signed = signature.text_signature(F.col("text"), KEYWORDS.shingle_size, KEYWORDS.num_perm)
    rows = docs.select("doc_id", signed.alias("signed"))
    return rows.select(
        "doc_id", "signed.n_shingles", signature.joined(F.col("signed.sig")).alias("sig")
    )


@query
def keyword_terms(spark, sf_dir):
    docs = keyword_quality.keyword_input(spoken(spark, sf_dir))
    features = keywords.term_features(docs)
    return features.select(
        "doc_id", "term", "tf", "tf_acronym", "tf_proper", F.col("median_sentence").cast("double"),
        "n_left", "all_left", "n_right", "all_right", "n_sentences", F.round("score", 9).alias("score"),
    )


@query
def keyword_extract(spark, sf_dir):
    docs = keyword_quality.keyword_input(spoken(spark, sf_dir))
    return keywords.keyword_rows(keywords.extract_keywords(docs, KEYWORDS.n_keywords))


@query
def keyword_signature(spark, sf_dir):
    m = KEYWORDS.n_keywords
    rows = keyword_quality.keyword_signatures(spoken(spark, sf_dir), (m,), KEYWORDS.num_perm)
    return rows.select("doc_id", signature.joined(F.col(f"kw_{m}")).alias("sig"))


# ---- pairs and distances ----


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.consecutive_pairs(raw_table(spark, sf_dir), [CFG.seed])


def neighbour_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive pairs with the raw shingle sets of both documents: the texts are joined, a third of a set's size, and cut then."""
    texts = documents(spark, sf_dir).select("doc_id", "text")
    # Ids alone fit few tasks; the sets are cut in as many as the joins have.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = neighbours(spark, sf_dir).select("pos", "a_doc_id", "b_doc_id").repartition(tasks, "pos")
    for side in ("a", "b"):
        own = texts.select(F.col("doc_id").alias(f"{side}_doc_id"), F.col("text").alias(f"{side}_text"))
        pairs = pairs.join(own, f"{side}_doc_id")
    sets = [text.shingle_ids(F.col(f"{side}_text"), METRICS.shingle_size).alias(f"{side}_set") for side in ("a", "b")]
    return pairs.select("pos", "a_doc_id", "b_doc_id", *sets)


PAIR = ["pos", "a_doc_id", "b_doc_id"]


@query
def jaccard_exact(spark, sf_dir):
    pairs = neighbour_sets(spark, sf_dir)
    return pairs.select(*PAIR, distances.jaccard_sets(F.col("a_set"), F.col("b_set")).alias("jaccard"))


@query
def set_intersection(spark, sf_dir):
    pairs = neighbour_sets(spark, sf_dir)
    return pairs.select(*PAIR, F.size(F.array_intersect("a_set", "b_set")).cast("long").alias("n_shared"))


@query
def set_union(spark, sf_dir):
    pairs = neighbour_sets(spark, sf_dir)
    return pairs.select(*PAIR, F.size(F.array_union("a_set", "b_set")).cast("long").alias("n_united"))


def distance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.pair_metrics(neighbours(spark, sf_dir))


def one_metric(name: str) -> Callable:
    def run(spark, sf_dir):
        return distance_metrics(spark, sf_dir).select(*PAIR, name)

    return run


for _key, _column in {
    "jaccard_estimate": "jaccard",
    "xor_distance": "xor",
    "cosine_distance": "cosine",
    "hamming_distance": "hamming",
    "euclidean_distance": "euclidean",
}.items():
    REGISTRY[_key] = one_metric(_column)


@query
def pairs_consecutive(spark, sf_dir):
    return neighbours(spark, sf_dir).select(*PAIR)


@query
def pairs_two_samples(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "title")
    samples = [accuracy.numbered_sample(docs, SAMPLE, seed) for seed in (1, 2)]
    return accuracy.sample_pairs(*samples, SAMPLE, []).select("a_doc_id", "b_doc_id")


@query
def pairs_self(spark, sf_dir):
    rows = accuracy.self_accuracy(documents(spark, sf_dir), FRACTION, METRICS.shingle_size, 64)
    return rows.select("doc_id", "n_pairs", F.round("sum_pct_diff", 6).alias("sum_pct_diff"))


@query
def pairs_exact(spark, sf_dir):
    return profile(*corpus.exact_sides(run_of(spark, sf_dir))).drop("cell")


@query
def pairs_signature(spark, sf_dir):
    return profile(*corpus.signature_profile(corpus.signed(run_of(spark, sf_dir)))).drop("cell")


def keyword_table(spark: SparkSession, sf_dir: str, split: corpus.Split | None = None) -> DataFrame:
    docs, m = spoken(spark, sf_dir), KEYWORDS.n_keywords
    signed = corpus.signed(split or run_of(spark, sf_dir, KEYWORDS))
    return signed.join(keyword_quality.keyword_signatures(docs, (m,), KEYWORDS.num_perm), "doc_id")


@query
def pairs_keyword(spark, sf_dir):
    return posting_profile(keyword_table(spark, sf_dir), f"kw_{KEYWORDS.n_keywords}").drop("cell")


# ---- searches ----


@query
def lsh_index(spark, sf_dir):
    train = corpus.signed(run_of(spark, sf_dir)).filter("is_train")
    return lsh.lsh_index(train, CFG.bands)


@query
def lsh_candidates(spark, sf_dir):
    signed = corpus.signed(run_of(spark, sf_dir))
    found = lsh.candidate_classes(signed.filter("is_query"), signed.filter("is_train"), CFG.bands)
    return found.select("query_id", "first_doc_id", "n_docs")


@query
def lsh_documents(spark, sf_dir):
    signed = corpus.signed(run_of(spark, sf_dir))
    found = lsh.candidate_documents(signed.filter("is_query"), signed.filter("is_train"), CFG.bands)
    return found.select("query_id", "doc_id")


@query
def lsh_append(spark, sf_dir):
    """Candidates of an index of the documents in English, to which all others are added after it is opened again."""
    split = run_of(spark, sf_dir)
    english = spoken(spark, sf_dir).filter("lang = 'en'").select("doc_id")
    signed = corpus.signed(split)
    train = signed.filter("is_train")
    index = lsh.build_index(train.join(english, "doc_id", "left_semi"), CFG.bands, fresh_path(spark, "lsh"))
    index = lsh.open_index(spark, index.folder)
    index.append(train.join(english, "doc_id", "left_anti"))
    return lsh.counted(lsh.search_index(signed.filter("is_query"), index)).drop("cell")


@query
def topk_exact(spark, sf_dir):
    return corpus.exact_top(run_of(spark, sf_dir), CFG.n_results).drop("cell")


@query
def topk_upto(spark, sf_dir):
    return corpus.exact_top(run_of(spark, sf_dir, CFG.with_(shingle_mode="upto")), CFG.n_results).drop("cell")


@query
def topk_signature(spark, sf_dir):
    return corpus.signature_top(corpus.signed(run_of(spark, sf_dir)), CFG.n_results).drop("cell")


@query
def topk_keyword(spark, sf_dir):
    return posting_top(keyword_table(spark, sf_dir), KEYWORDS.n_results, f"kw_{KEYWORDS.n_keywords}").drop("cell")


@query
def external_results(spark, sf_dir):
    split, docs = whole_split(spark, sf_dir)
    top = materialise(keyword_quality.external_top(split, WHOLE.n_results), "external")
    titles = docs.select("doc_id", text.underscore(F.col("title")).alias("title"))
    named = sliced_join(top, titles, ["doc_id"], "query_id", unique=True)
    return named.select("query_id", "rank", "doc_id", "title", "shared", "score")


@query
def external_without_first(spark, sf_dir):
    split, _ = whole_split(spark, sf_dir)
    return keyword_quality.external_top(split, WHOLE.n_results, without_first=True).drop("cell")


# ---- evaluation ----


@query
def found_by_both(spark, sf_dir):
    _, exact, approximate = quality.run_search(run_of(spark, sf_dir))
    return result_overlap(exact, approximate).select("query_id", "doc_id")


REGISTRY["result_overlap"] = REGISTRY.pop("found_by_both")


def candidate_part(signed: DataFrame, exact: DataFrame, cfg: SearchConfig) -> DataFrame:
    counts = lsh.candidate_counts(signed.filter("is_query"), signed.filter("is_train"), cfg.bands)
    return candidate_overlap(candidate_flags(exact, signed, cfg.bands), counts)


@query
def recall_lsh(spark, sf_dir):
    split = corpus.written_split(run_of(spark, sf_dir))
    signed = corpus.signed(split)
    return candidate_part(signed, corpus.exact_top(split, CFG.n_results), CFG).drop("cell")


@query
def recall_signature(spark, sf_dir):
    signed, exact, approximate = quality.run_search(run_of(spark, sf_dir))
    asked = candidate_part(signed, exact, CFG).select("cell", "query_id")
    return list_overlap(exact, approximate, "sig").join(asked, ["cell", "query_id"], "left_semi").drop("cell")


@query
def recall_keyword(spark, sf_dir):
    split = corpus.written_split(run_of(spark, sf_dir, KEYWORDS))
    signed = materialise(keyword_table(spark, sf_dir, split), "keyword-table")
    exact = materialise(corpus.exact_top(split, KEYWORDS.n_results), "exact")
    top = posting_top(signed, KEYWORDS.n_results, f"kw_{KEYWORDS.n_keywords}")
    asked = candidate_part(signed, exact, KEYWORDS).select("cell", "query_id")
    return list_overlap(exact, top, "kw").join(asked, ["cell", "query_id"], "left_semi").drop("cell")


@query
def recall_external(spark, sf_dir):
    split, _ = whole_split(spark, sf_dir)
    exact = materialise(corpus.exact_top(split, WHOLE.n_results), "exact")
    return list_overlap(exact, keyword_quality.external_top(split, WHOLE.n_results), "ext").drop("cell")


def with_config(rows: DataFrame, cfg: SearchConfig) -> DataFrame:
    return rows.drop("cell").select(
        F.lit(cfg.query_divisor).cast("long").alias("query_divisor"),
        F.lit(cfg.shingle_size).cast("long").alias("shingle_size"),
        F.lit(cfg.num_perm).cast("long").alias("num_perm"),
        F.lit(cfg.threshold).alias("threshold"),
        F.lit(cfg.n_results).cast("long").alias("n_results"),
        "*",
    )


@query
def query_stats(spark, sf_dir):
    return with_config(quality.search_quality(run_of(spark, sf_dir))[0], CFG)


@query
def keyword_stats(spark, sf_dir):
    docs = spoken(spark, sf_dir)
    rows = keyword_quality.keyword_quality(run_of(spark, sf_dir, KEYWORDS), docs)
    return with_config(rows, KEYWORDS).withColumn("n_keywords", F.lit(KEYWORDS.n_keywords).cast("long"))


@query
def whole_stats(spark, sf_dir):
    split, docs = whole_split(spark, sf_dir)
    rows = with_config(keyword_quality.whole_stats(split, docs, "pages"), WHOLE)
    return rows.drop("query_divisor").withColumn("n_keywords", F.lit(WHOLE.n_keywords).cast("long"))


@query
def global_stats(spark, sf_dir):
    return with_config(quality.search_quality(run_of(spark, sf_dir))[1], CFG)


@query
def accuracy_avg(spark, sf_dir):
    rows = accuracy.self_accuracy(documents(spark, sf_dir), FRACTION, METRICS.shingle_size, 64)
    return rows.agg(
        F.sum("n_pairs").alias("n_pairs"), F.round(F.sum("sum_pct_diff") / F.sum("n_pairs"), 9).alias("avg_pct_diff")
    )


@query
def metric_summary(spark, sf_dir):
    return accuracy.metric_summary(raw_table(spark, sf_dir), REPETITIONS)


@query
def error_counts(spark, sf_dir):
    split = run_of(spark, sf_dir)
    signed = corpus.signed(split)
    counts = lsh.candidate_counts(signed.filter("is_query"), signed.filter("is_train"), CFG.bands)
    asked = split.side("is_query", F.col("doc_id").alias("query_id"), "text")
    outcome = rejects.reject_rows(asked, CFG.shingle_size).join(counts, ["cell", "query_id"], "left")
    kept = F.col("reason").isNull()
    return outcome.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.count_if(~kept).alias("n_unreadable"),
        F.count_if(kept & F.col("n_candidates").isNull()).alias("n_without_candidates"),
        F.count_if(kept & F.col("n_candidates").isNotNull()).alias("n_evaluated"),
    )


@query
def error_stages(spark, sf_dir):
    docs = spoken(spark, sf_dir)
    stages = keyword_quality.query_stages(corpus.holdout(docs, KEYWORDS), docs)
    return stages.groupBy("stage").agg(F.count(F.lit(1)).alias("n_queries"))


@query
def index_coverage(spark, sf_dir):
    split = run_of(spark, sf_dir)
    indexed = corpus.signed(split).filter("is_train").select("doc_id", F.lit(1).alias("indexed"))
    return (
        split.side("is_train", "doc_id")
        .join(indexed, "doc_id", "left")
        .agg(F.count(F.lit(1)).alias("n_requested"), F.count("indexed").alias("n_indexed"))
    )


@query
def footprint(spark, sf_dir):
    size = F.lit(8 * KEYWORDS.num_perm).cast("long")
    return counted(spark, sf_dir, KEYWORDS.shingle_size).select(
        "doc_id", "shingle_bytes", size.alias("sig_bytes"), size.alias("keyword_sig_bytes")
    )


# ---- sweeps ----


def cell_values(spark: SparkSession, split: corpus.Split, sizes: tuple[int, ...]) -> DataFrame:
    rows = [(cell, size, split.n_docs[cell]) for cell, size in zip(split.cells, sizes, strict=True)]
    return F.broadcast(spark.createDataFrame(rows, "cell int, content_size long, n_docs long"))


@query
def sweep_size_perm(spark, sf_dir):
    split = corpus.holdout(documents(spark, sf_dir), CFG, SIZES)
    return quality.size_sweep(split, (64, 32)).join(cell_values(spark, split, SIZES), "cell").drop("cell")


@query
def sweep_keywords(spark, sf_dir):
    docs = spoken(spark, sf_dir)
    split = corpus.holdout(docs, KEYWORDS, KEYWORD_CONTENT)
    rows = keyword_quality.keyword_sweep(split, docs, KEYWORD_SIZES, TOPS)
    return rows.join(cell_values(spark, split, KEYWORD_CONTENT), "cell").drop("cell")


@query
def sweep_topn(spark, sf_dir):
    split, docs = whole_split(spark, sf_dir)
    return keyword_quality.top_sweep(split, docs, TOPS)


@query
def sweep_accuracy(spark, sf_dir):
    rows = accuracy.accuracy_sweep(documents(spark, sf_dir), SAMPLE, 6, NUM_PERMS, 128, SHINGLE_SIZES)
    return accuracy.mean_accuracy(rows)
