"""Exact removal of repeated byte strings by distributed suffix sorting.

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes. Not
all suffixes are needed for that. Each window of ``length`` bytes names one suffix: the one
that begins with the smallest hash of its ``LEAD``-byte substrings (ties: the leftmost). Equal
windows name suffixes at the same offset, so they meet where those suffixes meet. A named
suffix stands for a run of windows; it carries its context, the bytes that these windows span.

1. Texts are read once; named suffixes go out as hashes (of the lead and of the context).
   Leads that occur once are done. A context that occurs again is covered as a whole.
2. Suffixes whose lead occurs with different contexts are compared. Sampled splitters
   range-partition them by their leading bytes; each bucket is sorted by multikey quicksort,
   with the common prefix length of neighbours: the bytes from the suffix on, and the bytes
   before it read backwards. A window that begins r bytes before its suffix is repeated
   exactly if another suffix of that window offset is its neighbour in both orders, to r bytes
   backwards and ``length`` - r bytes forwards.
3. Repeated windows become spans per text, joined with the texts, which are cut there.

Leads with more than ``hot_lead`` different contexts are split into blocks and compared block
against block in separate tasks: nothing is lost and no task holds a large group. Equal
contexts have one representative. Splitters never part equal leads, so no comparison across
bucket boundaries is missing. Texts are known by their MD5; equal texts share their spans.

Defined cases: a null text is empty; texts shorter than ``length`` stay whole; repeated rows
repeat each other; matches never cross texts; an empty table gives an empty result; input
columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import passages
from shelfwise.llm.common import put, texts, written
from shelfwise.llm.passages import lowest

LENGTH = 400
LEAD = 32
HOT_LEAD = 20_000
CHUNK = 20_000

_NAMED = "h bigint, ctx bigint, n bigint, t binary, pos bigint, before bigint, after bigint"


def named_suffixes(body: bytes, length: int = LENGTH, lead: int = LEAD) -> tuple[np.ndarray, ...]:
    """Positions of the named suffixes, bytes of context before and from them, lead hashes."""
    data = np.frombuffer(body, dtype=np.uint8)
    n, w = len(data), length - lead + 1
    words = np.lib.stride_tricks.sliding_window_view(data, 8).view("<u8")[:, 0] if n >= 8 else None
    m = n - lead + 1
    with np.errstate(over="ignore"):
        h = words[:m] * np.uint64(0x9E3779B97F4A7C15)
        for i in range(8, lead, 8):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[i: i + m]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    named, count = lowest(h, w), n - length + 1
    first = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]]))
    last = np.concatenate([first[1:] - 1, [count - 1]])
    pos = named[first]
    return pos, pos - first, last + length - pos, h[pos].view(np.int64)


def _rows_of(body: bytes, length: int) -> list[tuple]:
    """Rows of one text; what repeats within it gives a span (h null) and one row of n = 2."""
    t = hashlib.md5(body).digest()
    pos, before, after, h = named_suffixes(body, length)
    digest = xxhash.xxh3_64_intdigest
    contexts = [
        digest(body[p - b: p + a], b) - (1 << 63)
        for p, b, a in zip(pos.tolist(), before.tolist(), after.tolist())]
    rows = list(zip(h.tolist(), contexts, itertools.repeat(1), itertools.repeat(t),
                    pos.tolist(), before.tolist(), after.tolist()))
    if len(set(contexts)) == len(contexts):
        return rows
    seen: dict[tuple, list] = {}
    for r in rows:
        seen.setdefault(r[:2], []).append(r)
    out, spans = [], []
    for group in seen.values():
        if len(group) > 1:
            spans.extend((r[4] - r[5], r[4] + r[6]) for r in group)
            out.append((*group[0][:2], 2, *group[0][3:]))
        else:
            out.append(group[0])
    out.extend((None, 0, 1, t, a, 0, b - a) for a, b in merged(spans))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of big-endian words, and bytes each shares with the row before it.

    Multikey quicksort, all groups of a depth at once: a group of rows equal so far is split
    by its next word; groups of one row are done.
    """
    n, depth = words.shape
    order = np.arange(n)
    start = np.zeros(n, dtype=bool)  # where a group begins
    start[:1] = True
    common = np.full(n, 8 * depth, dtype=np.int64)
    common[:1] = 0
    live = np.arange(n)
    for d in range(depth):
        if not len(live):
            break
        group = np.cumsum(start[live])
        key = words[order[live], d]
        by = np.lexsort((key, group))
        order[live] = order[live][by]
        key = key[by]
        differ = key[1:] != key[:-1]
        split = np.flatnonzero(differ & ~start[live[1:]])
        bits = key[split + 1] ^ key[split]
        same = np.zeros(len(split), dtype=np.int64)
        for i in range(1, 8):
            same += bits >> np.uint64(64 - 8 * i) == 0
        common[live[split + 1]] = 8 * d + same
        start[live[split + 1]] = True
        ends = np.append(start[1:], True)
        live = live[~(start[live] & ends[live])]
    return order, common


def repeated_windows(
    contexts: list[bytes], before: np.ndarray, after: np.ndarray, length: int
) -> np.ndarray:
    """For every context and offset r: does the window at r occur in another context too?"""
    n = len(contexts)
    found = np.zeros((n, length + 1), dtype=bool)
    wide = -(-length // 8) * 8
    right = np.zeros((n, wide), dtype=np.uint8)
    left = np.zeros((n, wide), dtype=np.uint8)
    for i, (c, b) in enumerate(zip(contexts, before.tolist())):
        data = np.frombuffer(c, dtype=np.uint8)
        right[i, : len(data) - b] = data[b:]
        left[i, :b] = data[:b][::-1]
    by_right, same_right = multikey_sort(right.view(">u8").astype(np.uint64))
    by_left, same_left = multikey_sort(left.view(">u8").astype(np.uint64))
    low, high = length - after, before
    rank_right = np.empty(n, dtype=np.int64)
    rank_left = np.empty(n, dtype=np.int64)
    for r in range(int(low.min()), int(high.max()) + 1):
        inside = np.flatnonzero((low <= r) & (r <= high))
        if len(inside) < 2:
            continue
        rank_right[by_right] = np.cumsum(same_right < length - r)
        rank_left[by_left] = np.cumsum(same_left < r)
        key = rank_right[inside] * (n + 1) + rank_left[inside]
        order = np.argsort(key)
        key = key[order]
        equal = key[1:] == key[:-1]
        found[inside[order[1:][equal]], r] = True
        found[inside[order[:-1][equal]], r] = True
    return found


def _spans(t: list, pos: np.ndarray, found: np.ndarray, length: int) -> Iterator[tuple]:
    edges = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    at, first = np.nonzero(edges == 1)
    _, last = np.nonzero(edges == -1)
    for i, a, b in zip(at.tolist(), first.tolist(), (last - 1).tolist()):
        yield t[i], int(pos[i]) - b, int(pos[i]) - a + length


def _bucket_spans(length: int):
    """Spans of a bucket: rows sorted by lead and block, worked off at boundaries of both."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        contexts = rows.column("bytes").to_pylist()
        before = rows.column("before").to_numpy()
        found = repeated_windows(contexts, before, rows.column("after").to_numpy(), length)
        found[rows.column("n").to_numpy() > 1] = False  # these are covered already
        spans = list(_spans(rows.column("t").to_pylist(), rows.column("pos").to_numpy(), found, length))
        return pa.RecordBatch.from_arrays([
            pa.array([s[0] for s in spans], pa.binary()), pa.array([s[1] for s in spans], pa.int64()),
            pa.array([s[2] for s in spans], pa.int64())], names=["t", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                rest = new if rest is None else pa.concat_tables([rest, new])
            if rest is None or not rest.num_rows or (batch is not None and rest.num_rows < CHUNK):
                continue
            keys = list(zip(rest.column("lead").to_pylist(), rest.column("p").to_pylist(), rest.column("q").to_pylist()))
            edges = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            if batch is None:
                edges.append(len(keys))
            a = 0
            while edges and a < edges[-1]:
                # as many whole groups as make a chunk, but never parts of two blocks of one lead
                b = next((e for e in edges if e - a >= CHUNK and e > a), edges[-1])
                part = [e for e in edges if a < e <= b]
                if any(keys[e - 1][1:] != (0, 0) for e in part):
                    b = part[0]
                yield work(rest.slice(a, b - a))
                a = b
            rest = rest.slice(a) if batch is not None else None

    return run


def repeated_spans(
    docs: DataFrame, text: str = "text", length: int = LENGTH, hot_lead: int = HOT_LEAD, words: int | None = None,
) -> DataFrame:
    """(t, spans): per distinct text (MD5) its repeated byte spans, sorted and apart.

    With ``words`` also n_passage_words, the words of its repeated passages of so many words.
    """
    body = texts(F.col(f"`{text}`"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in _NAMED.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column(0):
                data = value.as_py().encode("utf-8", "surrogatepass")
                if len(data) >= length:
                    rows.extend(_rows_of(data, length))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    long_enough = docs.select(body.alias("text")).where(F.octet_length("text") >= length)
    named = written(long_enough.mapInArrow(name, _NAMED))
    # Equal texts are one: keep what they name once, with the number of times it occurs.
    leads = named.where("h is not null").groupBy("h").agg(
        F.sum("n").alias("all"), F.min("ctx").alias("one"), F.max("ctx").alias("two")
    ).where("all > 1").select("h", (F.col("one") != F.col("two")).alias("mixed"))
    again = written(named.join(leads, "h"))
    span = ["t", (F.col("pos") - F.col("before")).alias("a"), (F.col("pos") + F.col("after")).alias("b")]
    whole = again.where("not mixed").select(*span)
    own = named.where("h is null").select(*span)

    each = again.where("mixed").groupBy("h", "ctx").agg(
        F.sum("n").alias("times"), F.min(F.struct("t", "pos", "before", "after")).alias("rep"))
    each = written(each)
    copied = again.where("mixed").join(
        each.where("times > 1").select("h", "ctx"), ["h", "ctx"], "left_semi").select(*span)

    asked = each.select("h", F.lit(None).cast("bigint").alias("ctx"), F.col("times").alias("n"), "rep.*")
    if words:  # these contexts come along in the same join
        word_leads = passages.repeated_leads(docs, body, words)
        asked = asked.unionByName(passages.contexts_to_compare(word_leads).select(
            "h", "ctx", "n", "t", F.col("a").cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("before"),
            F.col("size").cast("bigint").alias("after")))
    asked = asked.groupBy("t").agg(
        F.collect_list(F.struct("h", "ctx", "n", "pos", "before", "after")).alias("asked"))
    kept = docs.select(body.alias("text")).where(F.octet_length("text") >= (min(length, 2 * words - 1) if words else length))
    kept = kept.select("text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("t"))
    # Any of several equal texts serves: the smallest partition-local one, then one of all.
    found = kept.join(asked, "t").dropDuplicates(["t"])
    raw = F.col("text").cast("binary")
    item = F.col("x")
    contexts = written(found.select("t", raw.alias("raw"), F.explode("asked").alias("x")).select(
        "t", "x.h", "x.ctx", "x.n", "x.pos", "x.before", "x.after",
        F.substring(F.col("raw"), item.pos - item.before + 1, item.before + item.after).alias("bytes"),
    ), codec="zstd")  # contexts of a text overlap
    of_words = contexts.where("ctx is not null")
    contexts = contexts.where("ctx is null").drop("ctx")
    hot = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot_lead).select(
        "h", F.ceil(F.col("k") / hot_lead).cast("int").alias("blocks"))
    spread = contexts.join(hot, "h", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("t", "pos"), F.col("blocks")).cast("int")
    dealt = spread.select(
        "*", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("t", "n", "pos", "before", "after", "bytes",
             F.substring(F.col("bytes"), F.col("before") + 1, F.lit(LEAD)).alias("lead"),
             F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
    dealt = dealt.repartitionByRange("lead", "p", "q").sortWithinPartitions("lead", "p", "q")
    compared = dealt.mapInArrow(_bucket_spans(length), "t binary, a bigint, b bigint")

    every = whole.unionByName(own).unionByName(copied).unionByName(compared)
    spans = every.dropDuplicates().groupBy("t").agg(
        F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    return spans.join(passages.count_words(word_leads, of_words, words), "t", "full") if words else spans


def cut_repeats(
    docs: DataFrame, text: str = "text", length: int = LENGTH, hot_lead: int = HOT_LEAD,
    with_text: bool = True, words: int | None = None,
) -> DataFrame:
    """All rows with n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the kept text.

    With ``words`` also n_passage_words: words of the input text in runs of so many words that
    another row holds too, of any length in bytes. They are counted and not removed.

    Cuts are made between bytes; a character that a cut leaves incomplete goes from the kept
    text (not from the hash).
    """
    spans = repeated_spans(docs, text, length, hot_lead, words)
    names = [c for c in docs.columns if c != text]
    body = texts(F.col(f"`{text}`"))
    left = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row") if names else F.lit(None).alias("row"),
        body.alias("text"), F.unhex(F.md5(body.cast("binary"))).alias("t"))

    @F.pandas_udf("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string")
    def cut(bodies: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for value, own in zip(bodies, found):
            data = value.encode("utf-8", "surrogatepass")
            parts = merged([(s["a"], s["b"]) for s in own]) if own is not None else []
            at, pieces = 0, []
            for a, b in parts:
                pieces.append(data[at:a])
                at = b
            pieces.append(data[at:])
            kept = b"".join(pieces)
            out.append((len(data), len(data) - len(kept), len(parts), hashlib.sha256(kept).hexdigest(),
                        kept.decode("utf-8", "ignore") if with_text else None))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    done = left.join(spans, "t", "left").withColumn("r", cut("text", "spans"))
    results = {c: F.col(f"r.{c}") for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
    if with_text:
        results[text] = F.col("r.text")
    held = []
    if words:
        held = [F.coalesce("n_passage_words", F.lit(0)).alias("held")]
        results["n_passage_words"] = F.col("held")
    base = done.select(*[F.col("row").getField(c).alias(c) for c in names], "r", *held)
    return put(base, results).drop("r", "held")
