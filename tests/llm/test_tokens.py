import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from akin.llm import bpe, packing
from tests.llm.fixtures import odd_documents, table

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "aaaaaaa hello", "it's we'll '''s 'S", "<|startoftext|>Hi<|endoftext|>x <|ENDOFTEXT|>", "Σας ΟΔΟΣ İstanbul",
    "a\x1cb\x1d \x85z\u200bq", "e\u0301 é ﬁ ²³Ⅷ٣", "漢字かな 🎉🎊👍🏽", "x\x00y\x7f\x80", "ǅ ß ẞ <|startoftext| >",
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.mark.parametrize("kind", [bpe.Tokenizer, bpe.LibraryTokenizer])
def test_equals_the_library(library, kind):
    draw = random.Random(2)
    texts = ODD + ["".join(draw.choices("aeinorstlh'.,-! 0é", k=draw.randint(1, 40))) for _ in range(3000)]
    own = bpe.tokenizer(PATH, kind)
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(own.encode(text), "<u4").tolist()
        assert got == want, text
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_every_word_of_the_vocabulary(library):
    own = bpe.tokenizer(PATH)
    words = [t.removesuffix("</w>") for t in library.get_vocab(False) if t.endswith("</w>")]
    back = {c: b for b, c in enumerate(own.chars)}
    texts = [bytes(map(back.__getitem__, w)) for w in words]
    texts = [t.decode() for t in texts if t.isascii()][::7]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want.ids


def test_gadgets_on_hand_made_merges():
    vocab = {t: i for i, t in enumerate(["a", "b", "a</w>", "b</w>", "aa", "ab</w>", "aab</w>", "ba"])}
    merges = [("a", "a"), ("a", "b</w>"), ("aa", "b</w>"), ("b", "a")]
    automaton = bpe.Automaton(vocab, merges)
    names = {i: t for t, i in vocab.items()}
    read = lambda w: [names[i] for i in automaton.encode(w)]
    assert read("ab") == ["ab</w>"]
    assert read("aab") == ["aab</w>"]
    assert read("aaab") == ["aa", "ab</w>"]
    assert read("baab") == ["b", "aab</w>"]
    assert read("a") == ["a</w>"]


def test_a_full_memo_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_CHUNKS", 2)
    monkeypatch.setattr(bpe, "MEMO_ARCS", 2)
    own = bpe.Tokenizer(PATH)
    for text in ["one two three four five one two", "two six seven", "one one two"] * 2:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_rows(spark, library):
    rows = odd_documents()
    docs = table(spark, rows + rows[:2])
    found = bpe.digests(docs, PATH).collect()
    assert len(found) == len(rows) + 2
    texts = dict(rows)
    full = {r["doc_id"]: r for r in bpe.encoded(docs, PATH).collect()}
    for r in found:
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False)
        text = library.decode(want.ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(want.ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want.ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (full[r["doc_id"]]["ids"], full[r["doc_id"]]["decoded"]) == (want.ids, text)
    assert bpe.digests(docs.limit(0), PATH).collect() == []


def best_fit_count(lengths, capacity):
    """Item by item: large ones in pairs, small ones by best fit."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= x]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= x
        else:
            gaps.append(capacity - x)
    return len(gaps)


@pytest.mark.parametrize("seed", range(30))
def test_plans(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 30, 97])
    lengths = [draw.randint(1, draw.choice([capacity, capacity // 3, 4])) for _ in range(draw.randint(0, 300))]
    counts = {x: lengths.count(x) for x in set(lengths)}
    runs, sequences = packing.planned(counts, capacity)
    filled = {}
    numbers = {x: [] for x in counts}
    for i, run in enumerate(runs):
        last = i + 1 == len(runs) or runs[i + 1].length != run.length
        end = counts[run.length] if last else runs[i + 1].first
        for number in range(run.first, end):
            nth = number - run.first
            numbers[run.length].append(number)
            at = run.offset + nth % run.each * run.length
            filled.setdefault(run.sequence + nth // run.each, []).append((at, run.length))
    assert numbers == {x: list(range(n)) for x, n in counts.items()}
    assert sorted(filled) == list(range(sequences))
    for parts in filled.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= capacity
        assert sum(3 * n > capacity for _, n in parts) <= 2
    assert sequences <= best_fit_count(lengths, capacity) * 1.02 + 1


def test_a_length_beyond_the_capacity_is_an_error():
    with pytest.raises(ValueError):
        packing.planned({11: 1}, 10)


def test_packed_rows(spark, library):
    rows = odd_documents()
    docs = table(spark, [*rows, rows[3], (None, "no id")])
    found = packing.packed(docs, PATH, with_ids=True).toPandas()
    texts = dict(rows) | {None: "no id"}
    assert len(set(found.sequence_id)) <= -(-found.length.sum() // 4096) + 1
    for _, part in found.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]]
        assert part.length.sum() <= 4096
    repeated = rows[3][0]
    assert (found.doc_id == repeated).sum() == 2
    for doc, part in found[found.doc_id != repeated].sort_values("piece").groupby("doc_id", dropna=False):
        ids = np.array([*library.encode(texts[None if doc != doc else doc] or "", add_special_tokens=False).ids, 1], "<u4")
        assert part.start.tolist() == list(range(0, len(ids), 4096))
        assert [zlib.crc32(ids[s : s + 4096].tobytes()) for s in part.start] == part.ids_crc32.tolist()
        assert np.concatenate(part.ids.tolist()).tolist() == ids.tolist()
    assert packing.packed(docs.limit(0), PATH).collect() == []


def test_words_share_ids_with_what_closes_them(library):
    draw = random.Random(9)
    own = bpe.LibraryTokenizer(PATH)
    words = ["".join(draw.choices("abcdeßéñ", k=draw.randint(1, 9))) for _ in range(300)]
    text = " ".join(draw.choice(words) + draw.choice(["", "", ".", ",", "...", "?!", "'s", "-x", "9."]) for _ in range(5000))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_word_of_a_million_letters(library):
    draw = random.Random(4)
    word = "".join(draw.choices("abcdefghij", k=1_000_000))
    started = time.process_time()
    got = bpe.Tokenizer(PATH).encode(word)
    assert time.process_time() - started < 60
    short = word[:20_000]
    assert np.frombuffer(bpe.Tokenizer(PATH).encode(short), "<u4").tolist() == library.encode(short, add_special_tokens=False).ids
    labels = library.get_vocab(False)
    names = {i: t for t, i in labels.items()}
    assert "".join(names[i] for i in np.frombuffer(got, "<u4")) == word + "</w>"
