"""BPE encoding and decoding by a tokenization automaton.

The automaton's states are the tokens read last, its arcs are labelled with tokens. It starts with
all base symbols following each other freely. Every merge ``a b -> c``, in order, adds one gadget:
the arc ``b`` behind ``a`` is cut; ``c`` is entered from wherever ``a`` could be entered and leaves to
wherever ``b`` could lead, as the arcs stood when the merge was added. What remains after the last
merge accepts exactly the token sequences that BPE produces, one for each word. A gadget is
kept as four table entries (birth, parts, cut), and the resulting arcs are tabulated the first time a
word asks for them.

A word is read from left to right along arcs, trying longer labels first. Each prefix has one accepted
sequence, so a position of the word is entered once at most and reading takes a few table look-ups per token.
Decoding emits the labels of the arcs.

Task code travels by value, so a module's globals would be new in every task; compiled automata are kept
on the interpreter for as long as the Python worker lives.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from akin.llm.tables import kept

NEVER = 1 << 40
MEMO_CHUNKS = 1 << 19
MEMO_LENGTH = 256  # longer chunks are not remembered
MEMO_ARCS = 1 << 18
# Python's str.split() also splits at these four, which are no white space in Unicode.
SEPARATORS = "\x1c\x1d\x1e\x1f"
WHITE = regex.compile(r"\p{White_Space}+")
# Marks that may close a chunk, and the end of the Latin letters that every Unicode version knows.
MARKS, LATIN_END = ".,;:!?", "\u0250"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself, or one of those from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Automaton:
    """Compiled from the merges of a vocabulary whose words end with ``suffix``."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "</w>"):
        self.born: dict[int, int] = dict.fromkeys(vocab.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.cut: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        self.dead: set[int] = set()
        for step, (a, b) in enumerate(merges):
            self._gadget(step, vocab[a], vocab[b], vocab[a + b])
        vocab = {t: i for t, i in vocab.items() if i not in self.dead}
        # Labels inside a word, with -1 for strings that only begin one, and labels at a word's end.
        self.ends = {t.removesuffix(suffix): i for t, i in vocab.items() if t.endswith(suffix) and t != suffix}
        self.longest_end = max(map(len, self.ends), default=0)
        self.labels = {t[:n]: -1 for t in vocab for n in range(1, len(t))}
        self.labels.update((t, i) for t, i in vocab.items() if not t.endswith(suffix) or t == suffix)

    def _gadget(self, step: int, a: int, b: int, c: int) -> None:
        if c not in self.parts:
            if a in self.dead or b in self.dead or not self._trace(a, b, step):
                self.dead.add(c)  # no path for this gadget: earlier merges always come in between
            self.born[c], self.parts[c] = step, (a, b)
        self.cut.setdefault(a << 20 | b, step)

    def arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow ``state`` when all gadgets are in place."""
        key = state << 20 | token
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= MEMO_ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._trace(state, token)
        return known

    def _trace(self, state: int, token: int, until: int = NEVER) -> bool:
        born, cut = self.born, self.cut
        while cut.get(state << 20 | token, NEVER) >= until:
            p, q = born[state], born[token]
            if p < 0 and q < 0:
                return True
            if p > q:
                state, until = self.parts[state][1], p
            elif q > p:
                # Of a run of equal symbols the first two merge: the entry sees this very cut.
                token, until = self.parts[token][0], q + 1
            else:
                state, token, until = self.parts[state][1], self.parts[token][0], p
        return False

    def encode(self, word: str) -> list[int]:
        """Token ids of a pre-split word, given in byte characters."""
        n, arcs = len(word), self.arcs
        whole = self.ends.get(word) if n <= self.longest_end else None
        if whole is not None:
            return [whole]
        closed, path, rest = {0}, [], [self._labels_at(word, 0)]
        while rest:
            state = path[-1] if path else -1
            for token, end in rest[-1]:
                if end in closed:
                    continue
                if state < 0 or arcs.get(state << 20 | token) or self.arc(state, token):
                    break
            else:
                # Nothing leads on from here: the prefix is accepted, but not as a part of this word.
                rest.pop()
                if path:
                    path.pop()
                continue
            path.append(token)
            if end == n:
                return path
            closed.add(end)
            rest.append(self._labels_at(word, end))
        raise ValueError(f"the vocabulary has no symbols for {word!r}")

    def _labels_at(self, word: str, start: int) -> Iterator[tuple[int, int]]:
        """Labels that the word has from ``start`` on and where they end, the longest first."""
        labels, found, n = self.labels, [], len(word)
        for end in range(start + 1, n):
            token = labels.get(word[start:end])
            if token is None:
                break
            if token >= 0:
                found.append((token, end))
        token = self.ends.get(word[start:]) if n - start <= self.longest_end else None
        if token is not None:
            found.append((token, n))
        return reversed(found)


class Tokenizer:
    """Encodes and decodes whole texts as the vocabulary file describes.

    Special tokens in a text are taken as such. The rest goes through NFC and lower-casing, is cut by the
    file's pattern, and each piece goes through the automaton. Results are remembered by
    white-space chunk, at most twice MEMO_CHUNKS of them. A word of any length is read in a time that grows in proportion.
    """

    def __init__(self, path: str, compiled: bool = True):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"]) if compiled else None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        labels = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.labels = [labels[i] for i in range(len(labels))]
        self.split = regex.compile(pattern).finditer
        self.chars = byte_chars()
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, list[int]] = {}

    def _pieces(self, chunk: str) -> list[str]:
        if chunk.isascii() or "Cn" not in map(unicodedata.category, chunk):
            return [m[0] for m in self.split(chunk)]
        # Letters newer than the pattern's Unicode are no letters to it.
        shadow = "".join("\ue000" if unicodedata.category(c) == "Cn" else c for c in chunk)
        return [chunk[m.start() : m.end()] for m in self.split(shadow)]

    def _chunk(self, chunk: str) -> bytes:
        ids = []
        for piece in self._pieces(chunk):
            known = self.words.get(piece)
            if known is None:
                known = self.automaton.encode("".join(map(self.chars.__getitem__, piece.encode())))
                if len(piece) <= MEMO_LENGTH:
                    self.words[piece] = known
            ids += known
        return struct.pack(f"<{len(ids)}I", *ids)

    def _made(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that are not in the memo; from now on they are."""
        if len(self.memo) >= MEMO_CHUNKS:
            # The full memo serves on as the old one, so frequent chunks come back from there.
            self.old, self.memo = self.memo, {}
            self.words.clear()
        made = {c: self.old[c] for c in chunks if c in self.old}
        new = [c for c in chunks if c not in made]
        made.update(zip(new, self._packed(new), strict=True))
        self.memo.update((c, ids) for c, ids in made.items() if len(c) <= MEMO_LENGTH)
        return made

    def _packed(self, chunks: list[str]) -> list[bytes]:
        return list(map(self._chunk, chunks))

    def _plain(self, text: str) -> bytes:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Lower-casing goes by character; Python would give a final sigma its own form.
        text = text.replace("Σ", "σ").lower()
        chunks = WHITE.split(text) if any(c in text for c in SEPARATORS) else text.split()
        packed = list(map(self.memo.get, chunks))
        if None in packed:
            made = self._made(list({c for c, p in zip(chunks, packed, strict=True) if p is None}))
            packed = [made[c] if p is None else p for c, p in zip(chunks, packed, strict=True)]
        return b"".join(packed)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if "<" not in text or not self.specials.search(text):
            return self._plain(text)
        parts = self.specials.split(text)
        return b"".join(struct.pack("<I", self.special[p]) if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def decode(self, ids: list[int]) -> str:
        """The labels of the ids; the vocabulary file names no decoder, so they are joined by spaces."""
        return " ".join(map(self.labels.__getitem__, ids))


class LibraryTokenizer(Tokenizer):
    """The same ids with chunks encoded by the tokenizers library instead of the automaton.

    The pattern takes letters and marks apart, so a chunk of Latin letters and closing marks is the ids of its word and
    of its marks: words are shared by all chunks that end in different marks, and are encoded many at a time.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Encoder

        super().__init__(path, compiled=False)
        self.encoder = Encoder.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        # Special tokens are taken out before; what lower-casing turns into one is ordinary text.
        self.encoder.encode_special_tokens = True
        self.ends_word = np.array([label.endswith(self.suffix) for label in self.labels])
        self.words: dict[str, bytes] = {}

    def _packed(self, chunks: list[str]) -> list[bytes]:
        cut = [(core, chunk[len(core) :]) for chunk in chunks for core in (chunk.rstrip(MARKS),)]
        plain = [0 < len(core) <= MEMO_LENGTH and core.isalpha() and max(core) < LATIN_END for core, _ in cut]
        self._learn(dict.fromkeys(core for (core, _), p in zip(cut, plain, strict=True) if p))
        parts = [tail for (_, tail), p in zip(cut, plain, strict=True) if p and tail]
        parts += [chunk for chunk, p in zip(chunks, plain, strict=True) if not p]
        parts = [part for part in dict.fromkeys(parts) if part not in self.words]
        found = self.encoder.encode_batch_fast(parts, add_special_tokens=False)
        odd = {part: struct.pack(f"<{len(x)}I", *x.ids) for part, x in zip(parts, found, strict=True)}
        self.words.update((part, ids) for part, ids in odd.items() if len(part) <= MEMO_LENGTH)
        known = lambda part: odd.get(part) or self.words.get(part, b"")
        return [
            (self.words[core] + (known(tail) if tail else b"")) if p else known(chunk)
            for chunk, (core, tail), p in zip(chunks, cut, plain, strict=True)
        ]

    def _learn(self, words: Iterable[str]) -> None:
        """Encode words of letters as one text; the last token of each is the one that ends a word."""
        new = [w for w in words if w not in self.words]
        if not new:
            return
        ids = np.array(self.encoder.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)
        packed = ids.tobytes()
        if len(ends) != len(new):  # a vocabulary with words that no end label closes
            singly = self.encoder.encode_batch_fast(new, add_special_tokens=False)
            self.words.update((w, struct.pack(f"<{len(x)}I", *x.ids)) for w, x in zip(new, singly, strict=True))
            return
        self.words.update((w, packed[a:b]) for w, a, b in zip(new, [0, *ends[:-1].tolist()], ends.tolist(), strict=True))


def tokenizer(path: str, kind: type[Tokenizer] = Tokenizer) -> Tokenizer:
    """The tokenizer of a vocabulary file, made once in a Python worker."""
    return kept(("tokenizer", kind.__name__, path), lambda: kind(path))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Ids and decoded texts: doc_id, ids (array of int), decoded.

    One row per row of ``docs`` in place, nothing is shuffled. A null or empty text has no ids; repeated rows
    are encoded alike; an empty table gives none; other columns are ignored. A text of any length is encoded whole, in a time and
    memory in proportion to it. ``path`` names a vocabulary file that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            ids, decoded = [], []
            for text in batch.column("text").to_pylist():
                packed = own.encode(text or "")
                ids.append(struct.unpack(f"<{len(packed) // 4}I", packed))
                decoded.append(own.decode(ids[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    schema = docs.select("doc_id").schema.add("ids", ArrayType(IntegerType())).add("decoded", "string")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Digests of what ``encoded`` gives: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Taken in the task that encodes, so that ids and texts need not travel. Same rules as ``encoded``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        names = list(map(str, range(len(own.labels))))
        for batch in batches:
            counts, shas, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                packed = own.encode(text or "")
                ids = struct.unpack(f"<{len(packed) // 4}I", packed)
                counts.append(len(ids))
                shas.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = docs.select("doc_id").schema.add("n_tokens", "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema.add("ids_sha256", "string").add("decoded_sha256", "string"))
