import collections
import hashlib
import random
import re

import numpy as np
import pytest

from akin.llm import induced, minhash, suffix_dedup, tables
from akin.llm.components import components
from akin.llm.shingles import shingles
from tests.llm.fixtures import WORDS, odd_documents, prose, table


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(-3, 5)]
    rows = spark.createDataFrame([*edges, (None, 3), (3, None), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(rows).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == roots([e for e in edges if e[0] != e[1]], nodes)
    assert components(rows.limit(0)).collect() == []


def word_sets(texts):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    out = []
    for text in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(lower))
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def brute_near(rows):
    sets = word_sets([t for _, t in rows])
    ids = [i for i, _ in rows]
    pairs = [
        (ids[i], ids[j])
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    return dict(zip(ids, map(len, sets), strict=True)), roots(pairs, ids)


def test_shingles():
    assert len(shingles(None)) == len(shingles(" \n")) == 0
    assert len(shingles("a b c")) == 1
    assert shingles("A b\tC").tolist() == shingles("a B c").tolist()
    assert len(shingles("a b c d e a b c d e")) == 5
    assert shingles("É x").tolist() != shingles("é x").tolist()


@pytest.mark.parametrize("limit, block", [(2048, 256), (4, 3)])
def test_near_duplicates(spark, monkeypatch, limit, block):
    monkeypatch.setattr(minhash, "LIST", limit)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 1_000_000 if limit > 4 else 0)
    rows = odd_documents() + [(i, t) for i, (_, t) in enumerate(odd_documents(2), 1000)]
    sizes, want = brute_near(rows)
    found = minhash.near_duplicates(table(spark, rows + [rows[0]])).collect()
    assert len(found) == len(rows) + 1
    assert len(set(want.values())) < len(rows) - 40
    for r in found:
        assert (r["n_shingles"], r["component_id"]) == (sizes[r["doc_id"]], want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_without_ids_and_rows(spark):
    text = prose(random.Random(0), 30)
    rows = [(None, text), (4, text), (2, text), (None, "x y"), (5, ""), (6, None)]
    found = collections.Counter(map(tuple, minhash.near_duplicates(table(spark, rows)).collect()))
    n = len(shingles(text))
    assert found == collections.Counter(
        [(None, n, 2, False), (4, n, 2, False), (2, n, 2, True), (None, 1, None, False), (5, 0, 5, True), (6, 0, 6, True)]
    )
    left = minhash.deduplicated(table(spark, [*rows, (2, text), (2, "another text")]))
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == [2, 5, 6]
    assert left.columns == table(spark, []).columns
    assert minhash.near_duplicates(table(spark, [])).collect() == []


def brute_suffixes(text):
    cut = [text[i : text.index(0, i)] for i in range(len(text))]
    return cut


def check_suffixes(parts, folder):
    text = np.frombuffer(b"".join(p + b"\0" for p in parts) + bytes(8), np.uint8)
    body = text[:-8].tobytes()
    runs = list(induced.sorted_suffixes(text, str(folder)))
    at, common = (np.concatenate(x) for x in zip(*runs, strict=True))
    assert sorted(at) == list(range(len(body)))
    suffix = brute_suffixes(body)
    for k in range(1, len(at)):
        a, b = suffix[at[k - 1]], suffix[at[k]]
        assert a[: induced.CAP] >= b[: induced.CAP]
        same = 0
        while same < min(len(a), len(b), induced.CAP) and a[same] == b[same]:
            same += 1
        assert common[k] == same
    assert not list(folder.iterdir())


@pytest.mark.parametrize("slice_, budget, memory", [(1 << 18, 1 << 27, 1 << 22), (7, 200, 1 << 22), (5, 100, 3)])
def test_induced_sorting(tmp_path, monkeypatch, slice_, budget, memory):
    monkeypatch.setattr(induced, "SLICE", slice_)
    monkeypatch.setattr(induced, "BUDGET", budget)
    monkeypatch.setattr(induced, "IN_MEMORY", memory)
    draw = random.Random(slice_)
    for _ in range(40):
        letters = b"abc"[: draw.choice([1, 2, 3])]
        parts = [bytes(draw.choices(letters, k=draw.randint(1, draw.choice([5, 40, 230])))) for _ in range(draw.randint(1, 7))]
        check_suffixes([*parts, parts[0]], tmp_path)


def brute_repeats(rows):
    """By (id, text): bytes, removed, runs, hash of the rest; rows in corpus order."""
    seen, out = set(), {}
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(data[i : i + 100])
        left = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[key, text] = (len(data), sum(gone), runs, hashlib.sha256(left).hexdigest())
    return out


def repeated_documents(seed):
    draw = random.Random(seed)
    passage = [prose(draw, 30) for _ in range(4)]
    texts = [t for _, t in odd_documents(seed) if t is None or len(t) < 5000]
    texts += ["".join(draw.choice([prose(draw, 9), draw.choice(passage), draw.choice(passage)[10:190]]) for _ in range(6)) for _ in range(40)]
    texts += ["a" * draw.randint(90, 400) for _ in range(4)] + ["é" * 120, "è" * 120, "xyz" * 100, passage[0], passage[0][:150]]
    draw.shuffle(texts)
    return list(enumerate(texts, -5))


@pytest.mark.parametrize("seed, bits, slice_", [(1, 1 << 27, 1 << 18), (2, 4, 50)])
def test_repeats(spark, monkeypatch, seed, bits, slice_):
    monkeypatch.setattr(tables, "BITS", bits)
    monkeypatch.setattr(induced, "SLICE", slice_)
    if bits == 4:
        monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    rows = repeated_documents(seed)
    want = brute_repeats(rows)
    found = suffix_dedup.digests(table(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r)[1:] == want[r["doc_id"], rows[r["doc_id"] + 5][1]], r
    assert sum(w[1] for w in want.values()) > 10_000
    assert suffix_dedup.digests(table(spark, [])).collect() == []


def test_repeats_without_or_with_doubled_ids(spark):
    draw = random.Random(3)
    a, b, c = prose(draw, 40), prose(draw, 40), prose(draw, 40)
    rows = [(None, a + b), (2, a), (2, a), (1, b + c), (2, c + a), (None, a + b)]
    found = suffix_dedup.digests(table(spark, rows)).collect()
    assert len(found) == len(rows)
    by = collections.defaultdict(set)
    for r in found:
        by[r["doc_id"], r["n_bytes"]].add(tuple(r)[2:])
    sizes = [len(x.encode()) for x in (a, b, c)]
    # Rows equal in id and text have one result; id 1 comes first, rows without id last.
    assert all(len(v) == 1 for v in by.values())
    assert next(iter(by[1, sizes[1] + sizes[2]]))[0] == 0
    assert next(iter(by[None, sizes[0] + sizes[1]]))[0] > 0
    removed = next(iter(by[2, sizes[0]]))[0] + next(iter(by[2, sizes[2] + sizes[0]]))[0]
    assert sizes[0] + sizes[2] - 1 <= removed <= sizes[0] + sizes[2]


def test_characters_go_whole():
    text = "xéyéz".encode()
    assert suffix_dedup.kept_text(text, [2, 5]) == "xééz"
    assert suffix_dedup.kept_text(text, [1, 6]) == "xz"
    assert suffix_dedup.kept_text(text, [2, 3]) == "xéyéz"
    assert suffix_dedup.kept_text(text, None) == "xéyéz"
    assert b"".join(suffix_dedup.kept_parts(text, [1, 3, 4, 6])) == b"xyz"


def test_anchors_depend_on_the_string_alone():
    draw = random.Random(5)
    shared = prose(draw, 25).encode()[:100]
    hashes = []
    for _ in range(20):
        text = prose(draw, draw.randint(0, 30)).encode() + shared + prose(draw, draw.randint(0, 30)).encode()
        at = text.index(shared)
        owner, start, size, anchor, _ = suffix_dedup.segments([b"q" * draw.randint(0, 120), text])
        here = [h for o, s, z, h in zip(owner, start, size, anchor, strict=True) if o == 1 and s <= at and at + 100 <= s + z]
        assert len(here) == 1
        hashes += here
    assert len(set(hashes)) == 1


def test_words_are_known():
    assert len(set(WORDS)) == len(WORDS)


def test_parted_rows_have_no_partner_among_the_rest(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id as _row", "cast(id as string) as _bits", "id * 7 as key")
    small = spark.range(0, 21000, 700).selectExpr("id as k")
    for bits, most in ((1 << 27, 30), (1 << 10, 400), (2, 3000)):
        monkeypatch.setattr(tables, "BITS", bits)
        held, rest = tables.parted(docs, "key", small, "k")
        assert held.columns == rest.columns == docs.columns
        held, rest = ({r["key"] for r in x.collect()} for x in (held, rest))
        assert len(held) + len(rest) == 3000 and {r["k"] for r in small.collect()} <= held
        assert 30 <= len(held) <= most
    held, rest = tables.parted(docs, "key", small.limit(0), "k")
    assert held.count() == 0 and rest.count() == 3000
    assert tables.unused(docs, "_BITS") == "_BITS_"


def test_passages_go_from_documents_with_any_column(spark):
    draw = random.Random(6)
    shared = prose(draw, 40)
    rows = [(i, f"{i} {shared} {i}") for i in range(5)] + [(9, None), (10, "")]
    docs = table(spark, rows)
    left = suffix_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert texts[0] == rows[0][1] and texts[9] is None and texts[10] == ""
    assert all(len(texts[i]) < 20 for i in range(1, 5))
