"""URL filter: rules on host and path first, then a logistic regression on hashed character n-grams.

The model is fitted and applied with DataFrame expressions. A labelled URL table is small (its bound is
``MAX_EXAMPLES``): the examples become one row, an aggregation lists for each n-gram bucket the examples that hold it, and
the gradient steps run as one expression over both. Pages are then scored in place against one literal
array of weights, whose length never grows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
SIZES = (3, 4, 5)
STEPS, RATE, DECAY = 60, 100.0, 0.003
MAX_EXAMPLES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]

# Fixed values of the labelled table: words that name unwanted sites (gambling, pharmacy, loans, adult, piracy,
# counterfeits, advertising) and words that name ordinary ones. Names are single words and pairs of them; to the ordinary ones
# made-up names of open syllables are added. Each name stands at several addresses, dealt alike in both lists, so that
# domain, language and number say nothing.
BLOCKED = """casino poker slots roulette jackpot betting lottery viagra cialis pharmacy pills steroids payday loans forex bitcoin
giveaway prize winner adult webcam escorts dating torrent warez keygen cracked replica rolex discount coupons popups adserver
tracker spam phishing""".split()
ALLOWED = """library museum university school hospital garden weather news science history travel music theatre radio recipes
sports council archive journal books maps transport parish county village river forest mountain bakery physics biology
chemistry language poetry""".split()
CONSONANTS, VOWELS, MADE_UP = "bcdfghjklmnpqrstvwxyz", "aeiou", 40
NEXT, JOINED = (1, 7), ("-", "")
PREFIXES, DOMAINS, LANGUAGES = ("", "www.", "blog.", "m."), ("com", "net", "org"), ("en", "de", "fr", "es")
ENDINGS = ("", "/", ".html", "?page=2", "#top")
ADDRESSES = 4


def paired(words: list[str]) -> list[str]:
    """The words, and each joined to the words NEXT places on."""
    return words + [w + joint + words[(i + k) % len(words)] for k, joint in zip(NEXT, JOINED, strict=True) for i, w in enumerate(words)]


def made_up() -> list[str]:
    """Names of three or four open syllables, by rule."""
    open_ = [c + v for c in CONSONANTS for v in VOWELS]
    return ["".join(open_[(31 * i + 17 * k * (i + 1)) % len(open_)] for k in range(3 + i % 2)) for i in range(MADE_UP)]


def labelled_urls() -> list[tuple[str, int]]:
    """The built-in table: urls without scheme, and 1 for junk."""
    rows = []
    for names, label in ((paired(BLOCKED), 1), (paired(ALLOWED) + made_up(), 0)):
        for i, name in enumerate(names):
            for k in range(ADDRESSES):
                prefix, domain = PREFIXES[(i + k) % len(PREFIXES)], DOMAINS[(i // 2 + k) % len(DOMAINS)]
                language, ending = LANGUAGES[(i // 3 + k) % len(LANGUAGES)], ENDINGS[(i // 5 + k) % len(ENDINGS)]
                rows.append((f"{prefix}{name}.example.{domain}/{language}/{(37 * i + 911 * k) % 9973}{ending}", label))
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and for urls without ``://``."""
    found = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. ``rules`` is a short list."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r.host, r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        best = F.when(fits, found).otherwise(best)
    return best


def grams(host: Column, path: Column) -> Column:
    """The distinct buckets (array of int) of all character n-grams of ``^host/path$``, digits alike."""
    text = F.translate(F.concat(F.lit("^"), host, path, F.lit("$")), "123456789", "000000000")

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    return F.array_distinct(F.concat(*map(of_size, SIZES)))


def training_table(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: host, path, label (1: block)."""
    urls = spark.createDataFrame(labelled_urls(), "url string, label int")
    host, path = host_and_path(F.concat(F.lit("http://"), F.col("url")))
    return urls.select(host.alias("host"), path.alias("path"), "label")


def _logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def fitted(examples: DataFrame) -> DataFrame:
    """One row with ``weights``: an array of BUCKETS doubles, and ``bias``.

    ``examples`` (host, path, label) is a labelled table of at most MAX_EXAMPLES rows; more are an error.
    Each example's n-gram vector has length 1. Rows with a null label are left out.
    """
    rows = examples.where("label is not null").select("host", "path", F.col("label").cast("double").alias("label"))
    rows = rows.withColumn("grams", grams(F.col("host"), F.col("path")))
    every = F.array_sort(F.collect_list(F.struct("host", "path", "label", "grams")))
    one = rows.agg(every.alias("x")).select(
        F.when(F.size("x") <= MAX_EXAMPLES, F.col("x"))
        .otherwise(F.raise_error(F.lit(f"more than {MAX_EXAMPLES} labelled urls")))
        .alias("x"),
        F.lit(1).alias("model"),
    )
    # For each bucket the examples that hold it; the table is bounded, and so are its lists.
    of = one.select(F.posexplode("x").alias("i", "e")).select("i", F.explode("e.grams").alias("gram"), F.size("e.grams").alias("n"))
    lists = of.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("i", (1 / F.sqrt("n")).alias("v")))).alias("l"))
    lists = lists.agg(F.map_from_entries(F.collect_list(F.struct("gram", "l"))).alias("lists"), F.lit(1).alias("model"))
    nothing = F.array().cast("array<struct<i:int,v:double>>")
    buckets = F.sequence(F.lit(0), F.lit(BUCKETS - 1))
    held = F.transform(buckets, lambda b: F.coalesce(F.element_at("lists", b), nothing))
    both = one.join(F.broadcast(lists), "model").select("x", held.alias("held"))

    def step(state: Column, _: Column) -> Column:
        w, n = state["weights"], F.size("x")

        def error(e: Column) -> Column:
            total = F.aggregate(e["grams"], F.lit(0.0), lambda a, g: a + F.element_at(w, g + 1))
            return e["label"] - _logistic(state["bias"] + total / F.sqrt(F.size(e["grams"])))

        def moved(errors: Column) -> Column:
            slope = lambda l: F.aggregate(l, F.lit(0.0), lambda a, c: a + c["v"] * F.element_at(errors, c["i"] + 1))
            weights = F.zip_with(w, "held", lambda v, l: v * F.lit(1 - DECAY) + F.lit(RATE) * slope(l) / n)
            mean = F.aggregate(errors, F.lit(0.0), lambda a, e: a + e) / n
            return F.struct(weights.alias("weights"), (state["bias"] + mean).alias("bias"))

        # The errors are bound to a variable, else every use would compute them anew.
        return F.element_at(F.transform(F.array(F.transform("x", error)), moved), 1)

    start = F.struct(F.transform(buckets, lambda b: F.lit(0.0)).alias("weights"), F.lit(0.0).alias("bias"))
    return both.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step).alias("m")).select("m.weights", "m.bias")


def judged(pages: DataFrame, rules: list[Rule] | None = None, examples: DataFrame | None = None) -> DataFrame:
    """Judge every page: page_id, host, path, rule, verdict, score.

    The longest rule that fits decides; without one the model does (block from 0.5). ``score`` is the model's
    probability of block, given for every row. A null or malformed url has empty host and path, no
    rule, and is judged by the model on the empty string. An empty table gives no rows, repeated rows
    are judged alike, other columns are ignored. A url of any length is judged whole.
    """
    spark = pages.sparkSession
    model = fitted(training_table(spark) if examples is None else examples).first()
    weights = F.split(F.lit(",".join(map(repr, model["weights"]))), ",").cast("array<double>")
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    ruled = parsed.withColumn("found", longest_rule(F.col("host"), F.col("path"), RULES if rules is None else rules))
    scored = ruled.withColumn("grams", grams(F.col("host"), F.col("path")))
    margin = F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.element_at(weights, g + 1))
    score = _logistic(F.lit(model["bias"]) + margin / F.sqrt(F.size("grams")))
    return scored.withColumn("score", score).select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
