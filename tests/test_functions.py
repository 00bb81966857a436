import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from akin.config import PRIME, band_layout, permutations
from akin.functions import distances, signature, text
from tests.fixtures import normalise, shingles


def column(spark, values, schema, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r[0] for r in rows.orderBy("i").select(expr).collect()]


def test_normalise_keeps_tabs_and_edges(spark):
    values = ["  a\n\nb   c\td ", "x", "", None]
    assert column(spark, values, "string", text.normalise(F.col("v"))) == [" a b c\td ", "x", "", None]


def test_strip_prefix_removes_every_occurrence(spark):
    assert column(spark, ["A/xA/y", "z"], "string", text.strip_prefix(F.col("v"))) == ["xy", "z"]


def test_titles(spark):
    assert column(spark, ["two words"], "string", text.title_case(F.col("v"))) == ["Two Words"]
    assert column(spark, ["two words"], "string", text.underscore(F.col("v"))) == ["two_words"]
    full = text.title_and_text(F.col("v"), F.lit("body"))
    assert column(spark, ["t", None], "string", full) == ["t, body", None]


def test_shingles_of_edge_texts(spark):
    values = ["", "abc", "abcd", "abcde", "aaaaaaa", "éüéüéü", "x😀yz😀"]
    found = column(spark, values, "string", text.shingle_strings(F.col("v"), 4))
    assert found[:2] == [None, None]
    assert [set(f) for f in found[2:]] == [shingles(v, 4) for v in values[2:]]
    upto = column(spark, ["abcd"], "string", text.shingle_strings(F.col("v"), 3, "upto"))[0]
    assert set(upto) == shingles("abcd", 1) | shingles("abcd", 2) | shingles("abcd", 3)


def test_long_text_is_cut_without_loss(spark):
    value = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(text.SPAN * 2 + 5))
    found = column(spark, [value], "string", text.shingle_strings(F.col("v"), 5))[0]
    assert len(found) == len(set(found)) and set(found) == shingles(value, 5)
    assert len(column(spark, [value], "string", text.shingle_ids(F.col("v"), 5))[0]) == len(found)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text("aé€😀z\x00", min_size=9, max_size=60)), st.integers(1, 9), st.integers(1, 9))
def test_shingle_strings_of_a_batch(values, first, last):
    sizes = range(min(first, last), max(first, last) + 1)
    rows = [None if v is None else text.shingle_points(v, sizes) for v in values]
    want = [None if v is None else [s for k in sizes for s in sorted(shingles(v, k))] for v in values]
    assert text.string_lists(rows).to_pylist() == want


def test_long_shingles_of_many_letters():
    rng = random.Random(3)
    value = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(3000)) * 2
    assert text.string_lists([text.shingle_points(value, range(12, 13))]).to_pylist() == [sorted(shingles(value, 12))]


def test_a_batch_is_signed_without_holding_its_sets():
    rng = random.Random(5)
    texts = pa.array(["".join(rng.choice("abcdefgh ijklmnop") for _ in range(4000)) for _ in range(300)])
    permuter = signature.Permuter(permutations(16))
    tracemalloc.start()
    signed = signature.signed_texts(texts, 6, "exact", permuter)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The sets of the batch take 9 MB.
    assert len(signed) == 300 and peak < 3_000_000


@settings(max_examples=50, deadline=None)
@given(st.text(min_size=4, max_size=80), st.integers(1, 4))
def test_ids_are_one_to_one_with_shingles(value, k):
    value = value.encode("utf-8", "ignore").decode()
    if len(value) >= k:
        assert len(text.id_set(value, range(k, k + 1))) == len(shingles(value, k))


def test_counts_and_bytes_of_shingle_sets(spark):
    values = ["abc", "abcabcabc", "éüabéüab", "x😀yz😀x😀yz", None]
    found = column(spark, values, "string", text.shingle_counts(F.col("v"), 4))
    want = [shingles(v or "", 4) for v in values]
    assert [(r["n_shingles"], r["shingle_bytes"]) for r in found] == [
        (len(w), sum(len(x.encode()) for x in w)) for w in want
    ]


def test_html_to_text(spark):
    html = "<head><style>p{}</style></head><!-- x --><p>a&lt;b &amp;amp; c</p><script>var t='</p>';</script>d"
    assert column(spark, [html], "string", text.html_to_text(F.col("v"))) == ["a<b &amp; cd"]


def test_signature_is_the_minimum_of_every_permutation(spark):
    ids = text.id_set("the quick brown fox", range(4, 5))
    want = [min((a * (int(i) & PRIME) + b) % PRIME for i in ids) for a, b in permutations(32)]
    assert list(signature.Permuter(permutations(32)).sign(ids)) == want
    got = column(spark, ["the quick brown fox", "abc", None], "string",
                 signature.minhash(text.shingle_ids(F.col("v"), 4), 32))
    assert got == [want, None, None]
    both = column(spark, ["the quick brown fox", "abc", None], "string", signature.text_signature(F.col("v"), 4, 32))
    assert [b["sig"] for b in both] == got and [b["n_shingles"] for b in both] == [len(ids), 0, 0]


def test_shorter_signature_is_a_prefix():
    ids = text.id_set("some text to sign", range(3, 4))
    assert list(signature.Permuter(permutations(64)).sign(ids))[:16] == list(signature.Permuter(permutations(16)).sign(ids))


def test_estimate_error_shrinks_with_permutations():
    rng = np.random.default_rng(3)
    universe = rng.integers(0, 1 << 60, 600)
    a, b = universe[:400], universe[200:]
    errors = []
    for n in (16, 256):
        x, y = (signature.Permuter(permutations(n)).sign(np.unique(s)) for s in (a, b))
        errors.append(abs((x == y).mean() - 1 / 3))
    assert errors[1] < 0.08 and errors[1] <= errors[0] + 0.02


def test_band_layouts():
    assert [band_layout(0.3, n) for n in (128, 64, 32)] == [(37, 3), (21, 3), (12, 2)]
    assert band_layout(0.45, 128) == (25, 5)


def test_distances(spark):
    rows = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 7, 9])], "a array<bigint>, b array<bigint>")
    a, b = F.col("a"), F.col("b")
    row = rows.select(
        distances.jaccard_estimate(a, b).alias("e"),
        distances.hamming(a, b).alias("h"),
        distances.xor(a, b).alias("x"),
        distances.cosine(a, b).alias("c"),
        distances.euclidean(a, b).alias("l"),
        distances.jaccard_sets(a, b).alias("j"),
    ).first()
    x, y = np.array([1, 2, 3, 4.0]), np.array([1, 2, 7, 9.0])
    assert row["e"] == 0.5 and row["h"] == 1 - row["e"] and row["x"] == [0, 0, 4, 13]
    assert math.isclose(row["c"], 1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y))
    assert math.isclose(row["l"], np.linalg.norm(x - y)) and row["j"] == 2 / 6


def test_empty_sets_have_no_similarity(spark):
    rows = spark.createDataFrame([([], [])], "a array<bigint>, b array<bigint>")
    assert rows.select(distances.jaccard_sets(F.col("a"), F.col("b"))).first()[0] is None


def test_pct_change_rules(spark):
    rows = spark.createDataFrame([(2.0, 2.0), (1.0, 0.0), (0.0, 0.0), (1.0, 4.0)], "c double, p double")
    got = [r[0] for r in rows.select(distances.pct_change(F.col("c"), F.col("p"))).collect()]
    assert got == [100.0, 0.0, 100.0, 75.0]
