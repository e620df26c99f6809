"""Hidden Markov language model over words.

The model emits word classes: each of the ``head`` most frequent words is a class of its own,
every other word belongs to one of ``buckets`` classes by its last characters. Within a class
words have add-one probabilities from counts over all training texts, with one place for
unknown words. So P(text) is the exact likelihood of the class sequence under the hidden
states (scaled forward recursion over the whole text) times the words' shares of their classes,
and the probabilities of all texts sum to one.

Training. Word counts: each task counts, Spark sums; they stay a distributed table. Each text
is then written once as its class sequence, with its words outside the head. States: Baum-Welch;
every iteration, from the first to the last and at every size, runs over the class sequences of
all training texts: each task adds up its expected counts and Spark sums them by class block.
For these expectations long texts are taken in stretches of ``STRETCH`` words (scores never
are). What reaches driver and tasks has a fixed size: head words, class totals and the states'
tables.

Scoring: one pass over the class sequences gives their likelihood and the head words' part of
the base score; the other words of a text are looked up by a join with the count table.

Defined cases: a null or empty text is the end token alone; with no training text all words
are unknown; a null key is carried along (its fold is that of the empty text); repeated rows
are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import written

HEAD = 50_000
#: Longer words are never head words, so the head has a bounded size.
HEAD_BYTES = 64
BUCKETS = 4_096
STATES = 8
#: Iterations over all training texts: the two numbers are added up.
ITERATIONS = 2
SAMPLE_ITERATIONS = 10
STRETCH = 1_024
BLOCK = 1_024
END = b""
PRIOR = 50.0
#: Bytes of text that a task splits into words at once, and counted words that it holds.
SPLIT_BYTES = 8 << 20
TASK_WORDS = 400_000
BATCH_TOKENS = 600_000
#: Tokens whose sequences are put in order of length before they are dealt into batches.
SORTED_TOKENS = 4 * BATCH_TOKENS
#: Steps between two scalings; a step shrinks a row to 1e-20 of itself at worst, a double holds 1e-308.
SCALED_STEPS = 8
#: Files of class sequences that one task may take, where that leaves tasks for all cores.
TASK_FILES = 4
#: Rows that are transposed at once, few enough for a core's cache.
TURNED = 4_096


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words and the end token, which no word equals."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def _slices(bodies: pa.Array) -> Iterator[slice]:
    """Rows in turn, up to ``SPLIT_BYTES`` of text or one row at a time."""
    sizes = pc.fill_null(pc.binary_length(bodies), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.cumsum(sizes) - sizes
    edges = [*np.flatnonzero(np.diff(before // SPLIT_BYTES, prepend=-1)).tolist(), len(sizes)]
    return map(slice, edges, edges[1:])


def _words(bodies: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, without end tokens, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(bodies, "")))
    words, sizes = split.flatten(), pc.list_value_length(split).to_numpy().astype(np.int64)
    # Space at either end of a text leaves an empty piece there.
    real = pc.greater(pc.binary_length(words), 0)
    blank = np.flatnonzero(~real.to_numpy(zero_copy_only=False))
    np.subtract.at(sizes, np.searchsorted(np.cumsum(sizes), blank, side="right"), 1)
    return words.filter(real), sizes


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, c) of all tokens of the one text column; written to the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def add(words: pa.Array, counts: pa.Array) -> None:
            held.append(pa.table({"w": words.cast(pa.binary()), "c": counts}))

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.concat_tables(held).group_by("w", use_threads=False).aggregate([("c", "sum")])
            held.clear()
            yield from whole.select(["w", "c_sum"]).rename_columns(["w", "c"]).to_batches()

        for batch in batches:
            for rows in _slices(batch.column(0)):
                bodies = batch.column(0)[rows]
                found = _words(bodies)[0].value_counts()
                add(found.field("values"), found.field("counts"))
                add(pa.array([END]), pa.array([len(bodies)], pa.int64()))
                if sum(map(len, held)) > 2 * TASK_WORDS:
                    yield from flush()
        if held:
            yield from flush()

    parts = texts.mapInArrow(count, "w binary, c bigint")
    return written(parts.groupBy("w").agg(F.sum("c").alias("c")))


@dataclass
class Classes:
    """Word classes with their totals: sizes of fixed bound."""

    head: dict[bytes, int]
    head_counts: np.ndarray
    buckets: int
    bucket_counts: np.ndarray  # tokens per bucket
    bucket_words: np.ndarray  # distinct words per bucket
    total: int
    distinct: int

    @property
    def size(self) -> int:
        return len(self.head) + self.buckets

    def of(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """Class of each word; outside the head the last four bytes decide."""
        if isinstance(words, list):
            words = pa.array(words, pa.binary())
        head = pa.array(list(self.head), words.type)
        found = pc.fill_null(pc.index_in(words, value_set=head), -1).to_numpy().copy()
        rest = np.flatnonzero(found < 0)
        ends = pc.binary_slice(words.take(pa.array(rest)), -4).dictionary_encode()
        buckets = np.array([zlib.crc32(x) % self.buckets for x in ends.dictionary.to_pylist()], found.dtype)
        found[rest] = len(self.head) + buckets[ends.indices.to_numpy()]
        return found

    def shares(self) -> np.ndarray:
        """Smoothed probability of every class in the training tokens."""
        counts = np.concatenate([self.head_counts, self.bucket_counts]) + 1.0
        return counts / counts.sum()


def find_classes(counts: DataFrame, head: int = HEAD, buckets: int = BUCKETS) -> Classes:
    """The most frequent words and the totals of all others."""
    short = counts.where((F.octet_length("w") <= HEAD_BYTES) & (F.octet_length("w") > 0))
    top = short.orderBy(F.col("c").desc(), "w").limit(head).collect()  # bounded
    end = counts.where(F.octet_length("w") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    words = [END, *(bytes(r["w"]) for r in top)]
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    found = Classes({w: i for i, w in enumerate(words)},
                    np.array([end, *(r["c"] for r in top)], dtype=np.int64), buckets,
                    np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), totals[0], totals[1])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, n = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            i = found.of(batch.column(0)) - len(found.head)
            np.add.at(c, i[i >= 0], batch.column(1).to_numpy()[i >= 0])
            n += np.bincount(i[i >= 0], minlength=buckets)
        i = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(c[i]), pa.array(n[i])], names=["i", "c", "n"])

    sums = counts.mapInArrow(add, "i bigint, c bigint, n bigint").groupBy("i").agg(
        F.sum("c").alias("c"), F.sum("n").alias("n"))
    for r in sums.collect():  # at most one row per bucket
        found.bucket_counts[r["i"]], found.bucket_words[r["i"]] = r["c"], r["n"]
    return found


@dataclass
class States:
    """Start, transition and emission (class by state) probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _joined(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequences as one array, where each begins, and their lengths."""
    lengths = np.array([len(x) for x in seqs])
    return np.concatenate(seqs), np.cumsum(lengths) - lengths, lengths


def _by_length(
    joined: np.ndarray, at: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Order by falling length; classes laid out step by step; where the rows of each step begin."""
    order = np.argsort(-lengths, kind="stable")
    at, lengths = at[order], lengths[order]
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    edges = [0, *np.cumsum(active).tolist()]
    flat = np.empty(edges[-1], joined.dtype)
    for a, b in zip(edges, edges[1:]):
        now = at[: b - a]
        joined.take(now, out=flat[a:b], mode="clip")
        now += 1
    return order, flat.astype(np.intp), edges


def forward(model: States, seqs: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of every class sequence, by the scaled recursion."""
    return _forward(model, *_joined(seqs))


def _forward(model: States, joined: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    order, flat, edges = _by_length(joined, at, lengths)
    s = len(model.start)
    total = np.zeros(len(lengths))
    ones, emits = np.ones(s), np.empty((edges[1], s))
    alpha = model.emit[flat[: edges[1]]] * model.start
    for t in range(1, len(edges)):
        n = edges[t + 1] - edges[t] if t + 1 < len(edges) else 0
        if n < len(alpha):  # these end here
            total[n: len(alpha)] += np.log(alpha[n:] @ ones)
        if not n:
            break
        alpha = alpha[:n] @ model.move
        alpha *= model.emit.take(flat[edges[t]: edges[t + 1]], axis=0, out=emits[:n], mode="clip")
        if t % SCALED_STEPS == 0:
            scale = alpha @ ones
            alpha /= scale[:, None]
            total[:n] += np.log(scale)
    out = np.empty(len(lengths))
    out[order] = total
    return out


class Space:
    """Arrays that are used again from batch to batch."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def array(self, name: str, *shape: int) -> np.ndarray:
        n = int(np.prod(shape))
        if len(self.held.get(name, ())) < n:
            self.held[name] = np.empty(n)
        return self.held[name][:n].reshape(shape)


def expected(
    model: States, seqs: list[np.ndarray], first: list[bool], into: list[np.ndarray],
    space: Space | None = None,
) -> None:
    """Add the expected start, transition and emission counts of the sequences.

    Backward rows begin with the inverse of the last forward sum and are scaled where the
    forward rows were, so the product of both is the share of each state.
    """
    _expected(model, *_joined(seqs), np.array(first), into, space or Space())


def _expected(
    model: States, joined: np.ndarray, at: np.ndarray, lengths: np.ndarray, first: np.ndarray,
    into: list[np.ndarray], space: Space,
) -> None:
    order, flat, edges = _by_length(joined, at, lengths)
    s, steps = len(model.start), len(edges) - 1
    opening = first[order]
    ones = np.ones(s)
    emits = np.take(model.emit, flat, axis=0, out=space.array("emits", len(flat), s), mode="clip")
    alphas = space.array("alphas", len(flat), s)
    alpha = alphas[: edges[1]]
    alpha[:] = np.where(opening[:, None], model.start, 1.0 / s) * emits[: edges[1]]
    scales: dict[int, np.ndarray] = {}
    for t in range(1, steps):
        a, b = edges[t], edges[t + 1]
        last, alpha = alpha, alphas[a:b]
        np.matmul(last[: b - a], model.move, out=alpha)
        alpha *= emits[a:b]
        if t % SCALED_STEPS == 0:
            scales[t] = (alpha @ ones)[:, None]
            alpha /= scales[t]
    back = np.ascontiguousarray(model.move.T)
    moves = np.zeros((s, s))
    beta, ahead = np.empty((edges[1], s)), np.empty((edges[1], s))
    n = 0
    for t in range(steps - 1, -1, -1):
        a, b = edges[t], edges[t + 1]
        alpha = alphas[a:b]
        if n:
            x = ahead[:n]
            np.multiply(beta[:n], emits[b: b + n], out=x)
            if t + 1 in scales:
                x /= scales[t + 1]
            moves += alpha[:n].T @ x
            np.matmul(x, back, out=beta[:n])
        if b - a > n:  # these end here
            beta[n: b - a] = 1.0 / (alpha[n:] @ ones)[:, None]
        n = b - a
        alpha *= beta[:n]  # from here on the share of each state
    into[0] += alphas[: edges[1]][opening].sum(axis=0)
    into[1] += moves * model.move
    held = emits.reshape(s, -1)  # the emissions have done their work
    for i in range(0, len(flat), TURNED):
        held[:, i: i + TURNED] = alphas[i: i + TURNED].T
    for k in range(s):
        into[2][:, k] += np.bincount(flat, weights=held[k], minlength=model.emit.shape[0])


def _empty(states: int, classes: int) -> list[np.ndarray]:
    # A state's emissions lie together, as they are added up state by state.
    return [np.zeros(states), np.zeros((states, states)), np.zeros((classes, states), order="F")]


def maximised(sums: list[np.ndarray], shares: np.ndarray, prior: float = PRIOR) -> States:
    """New probabilities; emissions are drawn towards the overall shares by ``prior`` tokens."""
    start = sums[0] + 1.0
    move = sums[1] + 1.0
    emit = sums[2] + prior * shares[:, None]
    emit = np.ascontiguousarray(emit / emit.sum(axis=0))  # it is read class by class
    return States(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit)


def _sequences(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class sequences of a batch, none of them empty, as ``_joined`` gives them."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, wide)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    joined = np.frombuffer(data, np.uint8)[ends[0]: ends[-1]].view(kind)
    return joined, (ends[:-1] - ends[0]) // kind.itemsize, np.diff(ends) // kind.itemsize


def _stretches(
    joined: np.ndarray, at: np.ndarray, lengths: np.ndarray, stretch: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same sequences in stretches, and whether a stretch opens its sequence."""
    n = -(-lengths // stretch)
    of = np.repeat(np.arange(len(n)), n)
    done = (np.arange(len(of)) - (np.cumsum(n) - n)[of]) * stretch
    return joined, at[of] + done, np.minimum(stretch, lengths[of] - done), done == 0


def _near(found: Iterator[tuple]) -> Iterator[tuple]:
    """Batches of sequences with what goes with each; those of about equal length come together."""

    def dealt(some: list[tuple]) -> Iterator[tuple]:
        ahead = np.cumsum([0, *(len(x[0]) for x in some)])
        joined = np.concatenate([x[0] for x in some]) if len(some) > 1 else some[0][0]
        at = np.concatenate([x[1] + a for x, a in zip(some, ahead)])
        lengths, others = (np.concatenate([x[i] for x in some]) for i in (2, 3))
        order = np.argsort(lengths, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        edges = [*np.flatnonzero(np.diff(before // BATCH_TOKENS, prepend=-1)).tolist(), len(order)]
        for a, b in zip(edges, edges[1:]):
            own = order[a:b]
            yield joined, at[own], lengths[own], others[own]

    some, size = [], 0
    for item in found:
        some.append(item)
        size += len(item[0])
        if size >= SORTED_TOKENS:
            yield from dealt(some)
            some, size = [], 0
    if some:
        yield from dealt(some)


def opening_states(classes: Classes, states: int = STATES, seed: int = 11) -> States:
    """Sticky states whose emissions differ by chance; Baum-Welch tells them apart."""
    draw, shares = np.random.default_rng(seed), classes.shares()
    emit = shares[:, None] * (0.5 + 0.5 * draw.gamma(1.0, size=(classes.size, states)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return States(np.full(states, 1.0 / states), move, emit / emit.sum(axis=0))


def read_texts(docs: DataFrame, classes: Classes, text: str = "text", key: str | None = "doc_id") -> DataFrame:
    """Per row: id, the key k, the classes s as unsigned numbers, the words outside the head with
    their counts in ``tail``; written to the shared folder."""
    kind = _kind(classes)
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # fixed size
    pair = pa.struct([("w", pa.binary()), ("n", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for rows in _slices(batch.column(1)):
                bodies = batch.column(1)[rows]
                words, sizes = _words(bodies)
                coded = words.dictionary_encode()
                known, codes = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
                seq = own.of(known).astype(kind)[codes]
                of = np.repeat(np.arange(len(bodies)), sizes)
                outside = np.flatnonzero(seq >= len(own.head))
                pairs, times = np.unique(of[outside] * len(known) + codes[outside], return_counts=True)
                firsts = np.searchsorted(pairs, np.arange(len(bodies) + 1) * len(known))
                tail = pa.StructArray.from_arrays(
                    [known.take(pa.array(pairs % max(1, len(known)))), pa.array(times, pa.int64())], fields=list(pair))
                seq = np.insert(seq, np.cumsum(sizes), own.head[END])
                ends = np.concatenate([[0], np.cumsum(sizes + 1)]) * kind.itemsize
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[rows],
                    pa.Array.from_buffers(pa.binary(), len(bodies), [
                        None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(seq)]),
                    pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), tail, type=pa.list_(pair)),
                ], names=["k", "s", "tail"])

    k = F.lit(0) if key is None else F.col(f"`{key}`")
    rows = docs.select(k.alias("k"), F.col(f"`{text}`").alias("t"))
    shape = f"k {rows.schema['k'].dataType.simpleString()}, s binary, tail array<struct<w:binary,n:bigint>>"
    return written(rows.mapInArrow(read, shape).withColumn("id", F.monotonically_increasing_id()))


def _kind(classes: Classes) -> np.dtype:
    return np.min_scalar_type(classes.size)


def _fewer_tasks(df: DataFrame) -> DataFrame:
    """Every task sends tables of fixed size, so tasks take several files once all cores have some."""
    files = df.rdd.getNumPartitions()
    busy = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(1, min(files, busy), -(-files // TASK_FILES)))


def baum_welch(sequences: DataFrame, classes: Classes, model: States) -> States:
    """One full iteration over all class sequences (one column)."""
    s, size, kind = len(model.start), classes.size, _kind(classes)
    shared = sequences.sparkSession.sparkContext.broadcast(model)  # fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        sums, space = _empty(s, size), Space()
        pieces = (
            _stretches(*_sequences(batch.column(0), kind), STRETCH) for batch in batches if batch.num_rows)
        for group in _near(pieces):
            _expected(now, *group, sums, space)
        rows = [(-1, sums[0]), (-2, sums[1])]
        rows += [(i // BLOCK, sums[2][i: i + BLOCK]) for i in range(0, size, BLOCK)]
        rows = [(k, v) for k, v in rows if v.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in rows], pa.int64()),
             pa.array([v.tobytes() for _, v in rows], pa.binary())], names=["block", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(v.as_py())
                found[k] = found[k] + part if k in found else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int64()),
             pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["block", "v"])

    shape = "block bigint, v binary"
    parts = sequences.mapInArrow(count, shape).repartition("block").mapInArrow(add, shape)
    sums = _empty(s, size)
    for r in parts.collect():  # the states' tables, once
        v = np.frombuffer(r["v"])
        if r["block"] == -1:
            sums[0] += v
        elif r["block"] == -2:
            sums[1] += v.reshape(s, s)
        else:
            sums[2][r["block"] * BLOCK:][: len(v) // s] += v.reshape(-1, s)
    shared.unpersist()
    return maximised(sums, classes.shares())


def fit_states(
    sequences: DataFrame, classes: Classes, states: int = STATES, iterations: int = ITERATIONS,
    sample_iterations: int = SAMPLE_ITERATIONS,
) -> States:
    """States from the class sequences (one column) of all training texts.

    ``sample_iterations`` and ``iterations`` are added up; all of them run over all sequences.
    """
    model = opening_states(classes, states)
    sequences = _fewer_tasks(sequences)
    for _ in range(sample_iterations + iterations):
        model = baum_welch(sequences, classes, model)
    return model


def fit(
    texts: DataFrame, counts: DataFrame, states: int = STATES, iterations: int = ITERATIONS,
    head: int = HEAD, buckets: int = BUCKETS, sample_iterations: int = SAMPLE_ITERATIONS,
) -> tuple[Classes, States]:
    """Classes and states from the one text column and its word counts."""
    classes = find_classes(counts, head, buckets)
    rows = read_texts(texts, classes, texts.columns[0], None)
    return classes, fit_states(rows.select("s"), classes, states, iterations, sample_iterations)


def score_texts(
    docs: DataFrame, counts: DataFrame, classes: Classes, model: States,
    text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """Per row: the key, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    return score_read(read_texts(docs, classes, text, key), counts, classes, model, key)


def score_read(
    rows: DataFrame, counts: DataFrame, classes: Classes, model: States, key: str = "doc_id",
) -> DataFrame:
    """The same for texts that are read already."""
    kind, head = _kind(classes), len(classes.head)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # fixed size
    zeros = np.zeros(classes.buckets)
    # By class: the head words' part of the base score, whether it is known, places in a bucket.
    tables = rows.sparkSession.sparkContext.broadcast((
        np.concatenate([np.log10(classes.head_counts + 1.0), zeros]),
        np.concatenate([classes.head_counts > 0, zeros > 0]).astype(np.int64),
        np.concatenate([np.zeros(head), np.log10(classes.bucket_counts + classes.bucket_words + 1.0)])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, by_class = shared.value, tables.value

        def read() -> Iterator[tuple]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                joined, at, lengths = _sequences(batch.column(1), kind)
                ids = batch.column(0).to_numpy()
                edges = [*np.flatnonzero(np.diff(at // BATCH_TOKENS, prepend=-1)).tolist(), len(at)]
                for a, b in zip(edges, edges[1:]):
                    some, starts = joined[at[a]: at[b - 1] + lengths[b - 1]], at[a:b] - at[a]
                    others = np.empty(b - a, [("id", "i8"), ("head", "f8"), ("known", "i8"), ("places", "f8")])
                    others["id"] = ids[a:b]
                    for name, by in zip(("head", "known", "places"), by_class):
                        others[name] = np.add.reduceat(by[some], starts)
                    yield some, starts, lengths[a:b], others

        for joined, at, lengths, others in _near(read()):
            yield pa.RecordBatch.from_arrays(
                [pa.array(others["id"]), pa.array(lengths, pa.int64()),
                 pa.array(_forward(now, joined, at, lengths) / np.log(10.0)),
                 *(pa.array(others[x]) for x in ("head", "known", "places"))],
                names=["id", "n_tokens", "hmm", "head", "head_known", "places"])

    shape = "id bigint, n_tokens bigint, hmm double, head double, head_known bigint, places double"
    passed = rows.select("id", "s").mapInArrow(score, shape)
    spread = rows.select("id", F.explode("tail").alias("x")).select("id", "x.w", "x.n")
    # Words are counted once, so a task's part of the counts makes a small table; nothing is sorted.
    logs = counts.select("w", F.log10(F.col("c") + 1).alias("log")).hint("shuffle_hash")
    looked = spread.join(logs, "w").groupBy("id").agg(
        F.sum(F.col("n") * F.col("log")).alias("tail_log"), F.sum("n").alias("tail_known"))
    base = float(np.log10(classes.total + classes.distinct + 1.0))
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return rows.select("id", "k").join(passed, "id").join(looked, "id", "left").select(
        F.col("k").alias(key), "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(classes.total).cast("bigint").alias("train_tokens"),
        (F.col("head") + tail_log - F.col("n_tokens") * base).alias("base_score"),
        (F.col("hmm") + tail_log - F.col("places")).alias("score"))
