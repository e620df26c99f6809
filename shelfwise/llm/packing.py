"""Packing documents into training sequences: sum-of-squares online placement.

Every task packs the documents it reads, in one pass, without a shuffle. Its state is the
level array: how many open windows have each fill. A document goes to the fill level (or a new
window) that makes the sum of squared counts smallest, ties to the fullest window. What is
longer than a window is cut into whole windows first. At most ``open_windows`` windows are
open at a time: beyond that a document is cut so that it fills the fullest one.

At the end of a task the open windows are poured together: pieces of the emptiest windows are
cut to fill the fullest. One window at most stays partly filled; it is cut into sequences
whose lengths are powers of two, which need no padding. So padding is zero for any input.

A lost task is run again over the same rows in the same order. Sequence numbers are unique as
they begin with the number of the task's partition.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as often as
they occur; a null doc_id is carried along; an empty table gives no pieces.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
OPEN_WINDOWS = 512
#: Words whose ids a worker remembers at most; then it starts anew.
CACHE_WORDS = 1_000_000
#: Letters that byte-level models use for bytes: printable ones stand for themselves, the
#: others are numbered from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}
PROBES = ("the", "hello", "straße", "éàê", "ñandú", "übermäßig", "привет", "日本語", "a")

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


def packed(ids: list[int]) -> bytes:
    """The ids as little-endian 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds:
    """Token ids of texts, word by word.

    The tokenizer drops white space and never joins what it separates, so a text's ids are
    those of its words in turn; few words make up most of a text, and their ids are kept. It
    lower-cases, and parts letters from a mark that follows, so a word met in another case or
    with another final mark needs no new run of the tokenizer.
    """

    def __init__(self, path: str, end_id: int = END_ID, cache_words: int = CACHE_WORDS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.end_id, self.cache_words = end_id, cache_words
        self.known: dict[bytes, bytes] = {}  # a word's ids as little-endian 32-bit numbers
        self.direct = all(  # does the model alone give the ids of plain words?
            self.letters_only(w) == self.whole([w])[0] for w in PROBES)

    def whole(self, words: list[str]) -> list[list[int]]:
        return [c.ids for c in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def letters_only(self, word: str) -> list[int]:
        """Ids of a composed lower-case word of letters: one piece for the model, byte by byte."""
        mapped = word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return [t.id for t in self.model.tokenize(mapped)]

    def learn(self, new: list[bytes]) -> None:
        known, others = self.known, []
        for w in new:
            word = w.decode("utf-8", "surrogatepass")
            mark = word[-1:] if word[-1:] in (",", ".") else ""
            core = w[:-1] if mark else w
            # The normaliser composes first; some letters come apart into a letter and a mark.
            plain = normalize("NFC", word[:-1] if mark else word) if self.direct else ""
            if plain.isalpha() and plain.islower():
                ids = known.get(core)
                if ids is None:
                    ids = known[core] = packed(self.letters_only(plain))
                if mark:
                    known[w] = ids + self.marks[mark]
            else:
                others.append(w)
        if others:
            words = [w.decode("utf-8", "surrogatepass") for w in others]
            known.update(zip(others, map(packed, self.whole(words))))

    @cached_property
    def marks(self) -> dict[str, bytes]:
        return dict(zip(",.", map(packed, self.whole([",", "."]))))

    def __call__(self, text: str | None) -> np.ndarray:
        body = (text or "").encode("utf-8", "surrogatepass")
        if b"<|" not in body:  # else a special token's name may be there, whose case counts
            body = body.lower()
        found = body.split()
        if len(self.known) > self.cache_words:
            self.known = {}
        try:
            ids = b"".join(map(self.known.__getitem__, found))
        except KeyError:
            self.learn([w for w in set(found) if w not in self.known])
            ids = b"".join(map(self.known.__getitem__, found))
        return np.frombuffer(ids + packed([self.end_id]), dtype="<u4")


_kept: dict[tuple, WordIds] = {}


def word_ids(path: str, end_id: int) -> WordIds:
    """The tokenizer of this worker process; its words serve later tasks too."""
    if (path, end_id) not in _kept:
        _kept.clear()
        _kept[path, end_id] = WordIds(path, end_id)
    return _kept[path, end_id]


class Packer:
    """Open windows of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, first_sequence: int, open_windows: int = OPEN_WINDOWS):
        self.size, self.next, self.limit = size, first_sequence, open_windows
        self.counts = np.zeros(size + 1, dtype=np.int64)  # the level array
        self.levels: list[list[list]] = [[] for _ in range(size + 1)]
        self.open = 0
        self.closed: list[tuple] = []

    def emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.closed.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def level_for(self, length: int) -> int:
        """The fill level that makes the sum of squared counts smallest; 0: a new window."""
        top = self.size - length
        here, after = self.counts[1: top + 1], self.counts[1 + length:]
        cost = np.where(here > 0, 2 * (after - here) + 2, np.iinfo(np.int64).max)
        if here[-1]:
            cost[-1] = 1 - 2 * here[-1]  # a full window leaves the array
        best = top - int(np.argmin(cost[::-1]))
        new = 2 * int(self.counts[length]) + 1
        return best if here[best - 1] and cost[best - 1] <= new else 0

    def take(self, level: int) -> list:
        self.counts[level] -= 1
        self.open -= 1
        return self.levels[level].pop()

    def leave(self, pieces: list, fill: int) -> None:
        if fill == self.size:
            self.emit(pieces)
        else:
            self.counts[fill] += 1
            self.open += 1
            self.levels[fill].append(pieces)

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.size:
            self.emit([(doc, start, ids[start: start + self.size], total)])
            start += self.size
        while start < total:
            rest = ids[start:]
            level = self.level_for(len(rest))
            if level == 0 and self.open >= self.limit:
                level = int(np.flatnonzero(self.counts)[-1])
                rest = rest[: self.size - level]
            pieces = self.take(level) if level else []
            pieces.append((doc, start, rest.copy(), total))  # not a view of the whole text
            self.leave(pieces, level + len(rest))
            start += len(rest)

    def finish(self) -> None:
        """Pour the open windows together and cut the last one into powers of two."""
        filled = [(level, w) for level in range(self.size, 0, -1) for w in self.levels[level]]
        low, high = len(filled) - 1, 0
        while high < low:
            level, pieces = filled[high]
            while level < self.size and high < low:
                rest, source = filled[low]
                doc, start, ids, total = source.pop()
                part = ids[: self.size - level]
                pieces.append((doc, start, part, total))
                level += len(part)
                if len(part) < len(ids):
                    source.append((doc, start + len(part), ids[len(part):], total))
                filled[low] = (rest - len(part), source)
                low -= not source
            filled[high] = (level, pieces)
            if level == self.size:
                self.emit(pieces)
                high += 1
        for level, pieces in filled[high: low + 1]:
            self._powers(level, pieces)
        self.levels = [[] for _ in range(self.size + 1)]
        self.counts[:] = 0
        self.open = 0

    def _powers(self, level: int, pieces: list) -> None:
        queue = pieces[::-1]
        while level:
            want = 1 << (level.bit_length() - 1)
            level -= want
            part = []
            while want:
                doc, start, ids, total = queue.pop()
                cut = ids[:want]
                part.append((doc, start, cut, total))
                want -= len(cut)
                if len(cut) < len(ids):
                    queue.append((doc, start + len(cut), ids[len(cut):], total))
            self.emit(part)


def pack(
    docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id",
    window: int = WINDOW, end_id: int = END_ID, open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """One row per piece: where its ids come from and where they lie.

    ``tokenizer``: path of a tokenizer file that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        schema = pa.schema([(n, pa.int64()) for n in names])
        ids_of = word_ids(tokenizer, end_id)
        packer = Packer(window, TaskContext.get().partitionId() << 36, open_windows)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*packer.closed)) or [[] for _ in names]
            packer.closed = []
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], schema=schema)

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, ids_of(body.as_py()))
                if len(packer.closed) >= 20_000:
                    yield flush()
        packer.finish()
        yield flush()

    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, SCHEMA)
