"""Text clean-up and character shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Shingle strings leave the worker in parts of about PART spans of this many start positions: a batch of them is many
# times its texts.
SPAN = 4096
PART = 64

# Hexadecimal digits of the MD5 kept as keyword or term id: 15 digits are 60 bits.
ID_DIGITS = 15

# Fixed values of the shingle id: base of the polynomial, then shifts and factors that mix it.
ID_BASE = 0x9E3779B97F4A7C15
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
LAST_SHIFT = 31


def normalise(text: Column) -> Column:
    """Newlines become spaces, runs of spaces become one; nothing is trimmed, tabs stay.

    The pattern asks for two spaces: single ones stay as they are and need no replacement.
    """
    return F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), "  +", " ")


def strip_prefix(title: Column, prefix: str = "A/") -> Column:
    """Remove every occurrence of the namespace prefix."""
    return F.replace(title, F.lit(prefix), F.lit(""))


def title_and_text(title: Column, text: Column) -> Column:
    """Keyword input; null when either part is missing."""
    return F.when(title.isNotNull() & text.isNotNull(), F.concat_ws(", ", title, text))


def title_case(title: Column) -> Column:
    """Upper-case the first letter of each word."""
    return F.initcap(title)


def underscore(title: Column) -> Column:
    return F.replace(title, F.lit(" "), F.lit("_"))


def text_id(text: Column) -> Column:
    """60-bit id of a keyword or term."""
    return F.conv(F.substring(F.md5(text), 1, ID_DIGITS), 16, 10).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``, also from inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


def shingle_strings(text: Column, k: int, mode: str = "exact") -> Column:
    """Set of character shingles: length k (``exact``) or every length 1..k (``upto``); null for texts shorter than k.

    The set stays in the row of its text: no explode and no shuffle. Shingles of one length are in the order of their bytes.
    """
    sizes = _sizes(k, mode)

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            part, held = [], 0
            for value in batch:
                text = value.as_py()
                part.append(None if text is None or len(text) < k else shingle_points(text, sizes))
                held += len(text or "")
                if held >= PART * SPAN:
                    yield string_lists(part)
                    part, held = [], 0
            if part or not len(batch):
                yield string_lists(part)

    return cut(text)


def shingle_points(text: str, sizes: range) -> list[np.ndarray]:
    """The distinct shingles of each size as rows of code points, in order."""
    points = code_points(text)
    alphabet = distinct(points.copy())
    letters, base = np.searchsorted(alphabet, points), len(alphabet)
    keys, bound, found = letters, base, []
    for size in range(1, sizes.stop):
        n = len(points) - size + 1
        if size > 1:
            if bound * base > np.iinfo(np.int64).max:
                # Places among the distinct prefixes keep the order and are small.
                prefixes, keys = np.unique(keys, return_inverse=True)
                bound = len(prefixes)
            keys, bound = keys[:n] * base + letters[size - 1 :], bound * base
        if size in sizes:
            order = np.argsort(keys)
            first = order[starts_run(keys[order])]
            found.append(points[first[:, None] + np.arange(size)].astype("<u4"))
    return found


def string_lists(rows: list[list[np.ndarray] | None]) -> pa.ListArray:
    """Arrow lists of strings from rows of code points of several sizes; None becomes null."""
    blocks = [block for row in rows for block in row or ()]
    points = np.concatenate([np.zeros(0, "<u4"), *(block.ravel() for block in blocks)])
    lengths = np.concatenate([np.zeros(0, np.int64), *(np.full(*block.shape) for block in blocks)])
    ends = np.concatenate([[0], np.cumsum(utf8_widths(points))])[np.concatenate([[0], np.cumsum(lengths)])]
    values = points.tobytes().decode("utf-32-le").encode()
    strings = pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])
    counts = [0, *(sum(map(len, row or ())) for row in rows)]
    mask = pa.array([row is None for row in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), strings, mask=mask)


def utf8_widths(points: np.ndarray) -> np.ndarray:
    """Bytes of each character by the limits of UTF-8."""
    return 1 + sum((points >= limit).astype(np.int64) for limit in (0x80, 0x800, 0x10000))


def _sizes(k: int, mode: str) -> range:
    if mode not in ("exact", "upto"):
        raise ValueError(f"unknown shingle mode {mode!r}")
    return range(k if mode == "exact" else 1, k + 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)


def ids_in_place(points: np.ndarray, size: int) -> np.ndarray:
    """64-bit id of the shingle at every position: a polynomial of its code points, mixed."""
    n = max(0, len(points) - size + 1)
    value = points[:n].copy()
    for j in range(1, size):
        value = value * np.uint64(ID_BASE) + points[j : j + n]
    for shift, factor in MIX:
        value = (value ^ (value >> np.uint64(shift))) * np.uint64(factor)
    return value ^ (value >> np.uint64(LAST_SHIFT))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorts ``values``. A plain sort takes a third of the time of np.unique."""
    values.sort()
    return values[starts_run(values)]


def starts_run(ordered: np.ndarray) -> np.ndarray:
    """Which values differ from the one before them."""
    starts = np.ones(len(ordered), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=starts[1:])
    return starts


def id_set(text: str, sizes: range) -> np.ndarray:
    """Sorted distinct shingle ids of one text."""
    points = code_points(text)
    return distinct(np.concatenate([ids_in_place(points, size) for size in sizes])).view(np.int64)


def id_set_and_bytes(text: str, k: int, mode: str = "exact") -> tuple[np.ndarray, int]:
    """Sorted distinct shingle ids of one text, and the UTF-8 bytes of the distinct shingles; nothing for texts shorter than k."""
    points = code_points(text)
    if len(points) < k:
        return np.empty(0, dtype=np.int64), 0
    found = [_ids_and_bytes(points, size) for size in _sizes(k, mode)]
    ids = found[0][0] if len(found) == 1 else distinct(np.concatenate([ids for ids, _ in found]))
    return ids.view(np.int64), sum(n_bytes for _, n_bytes in found)


def _ids_and_bytes(points: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    ids = ids_in_place(points, size)
    if points.max() < 128:
        ids = distinct(ids)
        return ids, size * len(ids)
    order = np.argsort(ids)
    ids = ids[order]
    starts = starts_run(ids)
    ids, first = ids[starts], order[starts]
    # Summed over one place of each shingle.
    ends = np.concatenate([[0], np.cumsum(utf8_widths(points))])
    return ids, int((ends[first + size] - ends[first]).sum())


def list_array(rows: list) -> pa.ListArray:
    """Arrow lists of 64-bit integers from arrays; None becomes null."""
    lengths = np.array([0 if row is None else len(row) for row in rows], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    if ends[-1] > np.iinfo(np.int32).max:
        raise OverflowError("a batch holds more list elements than 32-bit offsets reach; use smaller batches")
    ends = ends.astype(np.int32)
    filled = [row for row in rows if row is not None]
    values = np.concatenate(filled) if filled else np.empty(0, dtype=np.int64)
    mask = pa.array([row is None for row in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()), mask=mask)


def shingle_ids(text: Column, k: int, mode: str = "exact") -> Column:
    """The shingle set as sorted 64-bit ids; null for texts shorter than k.

    Hashing whole Arrow batches with NumPy takes a sixth of the time of the same expression as
    nested array functions.
    """
    sizes = _sizes(k, mode)

    @F.arrow_udf("array<bigint>")
    def ids(batch: pa.Array) -> pa.Array:
        texts = batch.to_pylist()
        return list_array([id_set(t, sizes) if t is not None and len(t) >= k else None for t in texts])

    return ids(text)


def shingle_counts(text: Column, k: int) -> Column:
    """Struct (n_shingles, shingle_bytes) of a text's shingle set; zeros for texts shorter than k."""

    @F.arrow_udf("struct<n_shingles:bigint,shingle_bytes:bigint>")
    def count(batch: pa.Array) -> pa.Array:
        found = np.zeros((2, len(batch)), dtype=np.int64)
        for i, text in enumerate(batch):
            ids, n_bytes = id_set_and_bytes(text.as_py() or "", k)
            found[:, i] = len(ids), n_bytes
        return pa.StructArray.from_arrays([pa.array(column) for column in found], names=["n_shingles", "shingle_bytes"])

    return count(text)


# Comments, scripts and styles, tags, and the decoded entities, in this order.
HTML_RULES = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""),
    (r"(?s)<[^>]+>", ""),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&amp;", "&"),
)


def html_to_text(html: Column) -> Column:
    """Text nodes of a page without separators; scripts, styles and comments are dropped."""
    for pattern, replacement in HTML_RULES:
        html = F.regexp_replace(html, pattern, replacement)
    return html
