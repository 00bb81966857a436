"""The divergence audit against a plain count of everything, and its merge against sets."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from akin.llm import divergence
from tests.llm.fixtures import WORDS

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, term string, total int, value string, chunk int, block int, id string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_audit(rows):
    """Brute force over all terms of all sources, in Python integers."""
    rows = [(lang or "", source or "", TERM.findall(lowered(text or ""))) for text, lang, source in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        docs = Counter(t for _, _, terms in own for t in set(terms))
        kept = sorted(t for t, n in docs.items() if n >= 10)
        counts = {s: Counter(t for _, source, terms in own if source == s for t in terms) for s in {r[1] for r in own}}
        whole = sum(counts.values(), Counter())

        def prices(count):
            total = sum(count[t] for t in kept)
            return [1 + 1_000_000_000 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept]

        everywhere = prices(whole)
        for source in counts:
            mine = prices(counts[source])
            found = [("pair", o, sum((p - q) ** 2 // (p + q) for p, q in zip(mine, prices(counts[o])))) for o in counts if o != source]
            used = [("term", t, (p - q) ** 2 // (p + q)) for t, p, q in zip(kept, mine, everywhere) if counts[source][t] and p > q]
            for part, limit in ((found, None), (used, 10)):
                ranked = sorted(part, key=lambda r: (-r[2], r[1].encode()))[:limit]
                out |= {(lang, source, kind, item, value, rank) for rank, (kind, item, value) in enumerate(ranked, 1)}
    return out


def odd_rows(seed=3):
    draw = random.Random(seed)
    rows = []
    for i in range(400):
        lang = draw.choice(["en", "en", "en", "de", "", None, "xx"])
        source = draw.choice(["hot", "hot", "hot", *"abcdefghijklmnopqrstuvwxyz", "É", "", None])
        words = [draw.choice(WORDS + ["Straße", "naïve\x80x", "É"]) for _ in range(draw.randint(0, 30))]
        words += [source or "none"] * draw.randint(0, 3)
        rows.append((draw.choice([" ", "\n", "1", "_"]).join(words).title(), lang, source))
    rows += [("", "en", "silent"), (None, "en", "mute"), ("12 34", "en", "silent"), ("only one", "lone", "s"), (rows[0][0], *rows[0][1:])]
    rows.append(("the house " * 50_000, "en", "long"))
    return [r for r in rows if r[1] != "xx"] + [(f"rare{i}", "xx", "abc"[i % 3]) for i in range(9)]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, *[None] * 7) for i, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("chunk_bits, block, held, text_bytes", [(16, 16, 300_000, 1 << 22), (2, 3, 40, 64)])
def test_audit_is_brute_force(spark, monkeypatch, chunk_bits, block, held, text_bytes):
    for name, value in {"CHUNK_BITS": chunk_bits, "BLOCK": block, "HELD": held, "TEXT_BYTES": text_bytes}.items():
        monkeypatch.setattr(divergence, name, value)
    rows = odd_rows()
    got = divergence.audited(frame(spark, rows)).collect()
    assert {tuple(r) for r in got} == plain_audit(rows) and len(got) == len(plain_audit(rows))


def test_without_rows_and_without_kept_terms(spark):
    assert divergence.audited(frame(spark, [])).collect() == []
    got = divergence.audited(frame(spark, [("a b", "en", "x"), (None, "en", None)])).collect()
    assert {tuple(r) for r in got} == {("en", "x", "pair", "", 0, 1), ("en", "", "pair", "x", 0, 1)}


def test_galloping_finds_what_sets_find():
    draw = np.random.default_rng(1)
    for _ in range(300):
        sizes = draw.choice([0, 1, 3, 700, 5000], 2)
        a, b = (np.unique(draw.integers(0, draw.choice([10, 1000, 100_000]), n)) for n in sizes)
        left, right = divergence.common(a, b)
        assert a[left].tolist() == b[right].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_prices_are_exact_at_large_counts(spark):
    cases = [(0, 0, 1), (5, 9, 3), (10**13 + 7, 3 * 10**13 + 1, 10**7), (4 * 10**15, 4 * 10**15 + 3, 10**6)]
    want = [1 + 1_000_000_000 * (n + 2) // (total + 2 * v) for n, total, v in cases]
    assert [int(divergence.prices(np.array([n]), total, v)[0]) for n, total, v in cases] == want
    rows = spark.createDataFrame(cases, "n long, total long, terms long").select(divergence.price("n", "total").alias("p")).collect()
    assert [r["p"] for r in rows] == want
