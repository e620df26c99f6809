"""Words of repeated passages, by the number of words and whatever their length in bytes.

Words are runs of bytes other than ASCII white space. A word counts if it lies in a run of
``words`` words that some other row holds too; repeats within one row alone do not count.

Each such window names one lead, the smallest hash of its runs of ``LEAD`` words (ties: the
leftmost), and a lead stands for the windows that name it, its context. Equal windows name equal
leads at the same offset. Leads that only one row holds are done; a context that more rows hold
counts as a whole; windows of other contexts are compared by hashes of 64 bits below their lead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import written

WORDS = 51
LEAD = 10
#: Bytes of text that a task splits into words at once.
SPLIT_BYTES = 4 << 20

_STEP = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_NAMED = "h bigint, ctx bigint, new_h int, t binary, firsts array<int>, windows int, a int, size int"


def lowest(h: np.ndarray, w: int) -> np.ndarray:
    """Of every window of ``w`` hashes the place of the smallest (by 32 bits; ties: the leftmost)."""
    m = len(h)
    packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    rows = -(-m // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max)
    padded[:m] = packed
    padded = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = m - w + 1
    return (np.minimum(back[:count], ahead[w - 1: w - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _slices(bodies: list[bytes]) -> Iterator[slice]:
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    before = np.cumsum(sizes) - sizes
    edges = [*np.flatnonzero(np.diff(before // SPLIT_BYTES, prepend=-1)).tolist(), len(sizes)]
    return map(slice, edges, edges[1:])


def _coded(bodies: list[bytes]) -> tuple[np.ndarray, ...]:
    """Codes of the words of all texts, their text, first and last byte + 1 there, first word of a text."""
    data = b"\n".join(bodies)
    at = np.cumsum([0, *(len(b) + 1 for b in bodies)])
    edges = np.flatnonzero(np.diff(_SPACE[np.frombuffer(data, dtype=np.uint8)], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    one = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(data)])), pa.py_buffer(data)])
    words = pc.ascii_split_whitespace(one).flatten()
    found = words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()
    codes = np.fromiter(
        map(xxhash.xxh3_64_intdigest, found.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(found.dictionary))
    v = codes[found.indices.to_numpy()]
    own = np.searchsorted(at, starts, side="right") - 1
    return v, own, starts - at[own], ends - at[own], np.searchsorted(starts, at)


def _runs(v: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    if size == 1:
        return v
    k = size // 2
    half = _runs(v, k)
    h = half[:-k] * np.uint64(pow(_STEP, k, 1 << 64)) + half[k:]
    return h[:-1] * np.uint64(_STEP) + v[size - 1:] if size % 2 else h


def _named_words(bodies: list[bytes], words: int) -> list[pa.Array] | None:
    """The columns of ``_NAMED``: a row for each context of a text, with all places it begins at."""
    v, own, starts, ends, begin = _coded(bodies)
    if len(v) < words:
        return None
    h, whole = _runs(v, LEAD), _runs(v, words)
    named = lowest(h, words - LEAD + 1)
    inside = own[: len(named)] == own[words - 1:]  # windows within one text
    other = named[1:] != named[:-1]
    first = np.flatnonzero(inside & np.concatenate([[True], other | ~inside[:-1]]))
    last = np.flatnonzero(inside & np.concatenate([other | ~inside[1:], [True]]))
    pos, text = named[first], own[first]
    h = h[pos].view(np.int64)
    # the first and the last window overlap, so both and their places stand for all words between
    ctx = (whole[first] * np.uint64(0xBF58476D1CE4E5B9)) ^ (whole[last] * np.uint64(0x94D049BB133111EB))
    ctx = (ctx + ((pos - first) * 64 + last - first).astype(np.uint64) * np.uint64(_STEP)).view(np.int64)
    order = np.lexsort((ctx, h, text))
    text, h, ctx, first, last = text[order], h[order], ctx[order], first[order], last[order]
    step = np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])])[: len(text)]
    new = np.flatnonzero(step | np.concatenate([[True], ctx[1:] != ctx[:-1]])[: len(text)])
    firsts = pa.ListArray.from_arrays(
        pa.array(np.append(new, len(text)), pa.int32()), pa.array(first - begin[text], pa.int32()))
    text, first, last = text[new], first[new], last[new]
    digests = [hashlib.md5(b).digest() for b in bodies]
    at = pa.py_buffer(np.arange(len(new) + 1, dtype=np.int32) * 16)
    t = pa.Array.from_buffers(pa.binary(), len(new), [None, at, pa.py_buffer(b"".join(digests[i] for i in text.tolist()))])
    a = starts[first]
    return [pa.array(h[new]), pa.array(ctx[new]), pa.array(step[new].astype(np.int32)), t, firsts,
            pa.array(last - first + 1, pa.int32()), pa.array(a, pa.int32()), pa.array(ends[last + words - 1] - a, pa.int32())]


def repeated_leads(docs: DataFrame, body: Column, words: int) -> DataFrame:
    """Named leads that more than one row holds; mixed: with different contexts."""
    if not LEAD <= words < LEAD + 62:
        raise ValueError(f"words must be from {LEAD} to {LEAD + 61}")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _NAMED.split(", ")]
        for batch in batches:
            bodies = batch.column(0).cast(pa.binary()).to_pylist()
            for part in _slices(bodies):
                columns = _named_words(bodies[part], words)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    long_enough = docs.select(body.alias("text")).where(F.octet_length("text") >= 2 * words - 1)
    named = written(long_enough.mapInArrow(name, _NAMED), codec="zstd")
    leads = named.groupBy("h").agg(
        F.sum("new_h").alias("held"), F.min("ctx").alias("one"), F.max("ctx").alias("two")
    ).where("held > 1").select("h", (F.col("one") != F.col("two")).alias("mixed"))
    return written(named.join(leads, "h").drop("new_h"), codec="zstd")


def contexts_to_compare(leads: DataFrame) -> DataFrame:
    """One place for each context of a mixed lead, and how many rows (n) hold that context."""
    each = leads.where("mixed").groupBy("h", "ctx").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "a", "size")).alias("rep"))
    return each.select("rep.t", "h", "ctx", "n", "rep.a", "rep.size")


def count_words(leads: DataFrame, contexts: DataFrame, words: int) -> DataFrame:
    """(t, n_passage_words) of texts that hold repeated words; contexts: t, h, ctx, n, bytes."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, own, _, _, begin = _coded(batch.column("bytes").to_pylist())
            if len(v) < words:
                continue
            at = np.flatnonzero(own[: len(v) - words + 1] == own[words - 1:])
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).take(pa.array(own[at])) for c in ("h", "ctx", "n", "u")],
                pa.array(at - begin[own[at]], pa.int32()), pa.array(_runs(v, words)[at].view(np.int64)),
            ], names=["h", "ctx", "n", "u", "i", "w"])

    hashed = contexts.select("h", "ctx", "n", F.xxhash64("t").alias("u"), "bytes").mapInArrow(
        windows, "h bigint, ctx bigint, n bigint, u bigint, i int, w bigint")
    again = hashed.groupBy("h", "w").agg(
        F.min("u").alias("one"), F.max("u").alias("two"), F.max("n").alias("n")
    ).where("one != two or n > 1").select("h", "w")
    some = hashed.where("n = 1").join(again, ["h", "w"], "left_semi").groupBy("h", "ctx").agg(
        F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
    copied = contexts.where("n > 1").select("h", "ctx", F.lit(-1).cast("bigint").alias("mask"))
    every = F.expr("shiftleft(1L, windows) - 1")
    mixed = leads.where("mixed").join(some.unionByName(copied), ["h", "ctx"]).select(
        "t", "firsts", F.col("mask").bitwiseAND(every).alias("mask"))
    parts = leads.where("not mixed").select("t", "firsts", every.alias("mask")).unionByName(mixed)

    @F.pandas_udf("bigint")
    def covered(firsts: pd.Series, sizes: pd.Series, masks: pd.Series) -> pd.Series:
        bits = np.arange(words - LEAD + 1)
        out = []
        for first, size, mask in zip(firsts, sizes, masks):
            held = (np.repeat(np.asarray(mask), size)[:, None] >> bits) & 1 == 1
            starts = np.unique((np.asarray(first)[:, None] + bits)[held])
            out.append(int(np.minimum(np.diff(starts), words).sum()) + words)
        return pd.Series(out, dtype="int64")

    # rows of equal texts give equal parts
    held = parts.dropDuplicates().groupBy("t").agg(F.collect_list(F.struct("firsts", "mask")).alias("x"))
    return held.select("t", covered(
        F.flatten("x.firsts"), F.transform("x.firsts", F.size), F.col("x.mask")).alias("n_passage_words"))
