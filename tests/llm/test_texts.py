"""Quality, language, language model and packing against plain versions; odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from odd_tables import docs, nothing  # noqa: F401
from shelfwise.llm import hmm, langid, packing, quality
from shelfwise.llm.queries import QUERIES, tokenizer_path

MEDIUM = "/root/testdata/sf0.01"


def test_quality_ranks_pairs_and_takes_odd_rows(spark, docs, nothing):
    draw = np.random.default_rng(0)
    x = np.concatenate([draw.normal(1, 1, (200, 4)), draw.normal(-1, 1, (60, 4))])
    good = np.arange(260) < 200
    model = quality.fit_arrays(x, good)
    assert ((model.scores(x) >= 0.3) == good).mean() > 0.9
    labels = spark.createDataFrame(
        [(7 * i, i % 2) for i in range(20)] + [(None, 1), (0, None), (7, 1)], "doc_id bigint, quality int")
    fitted = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, fitted).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["predicted"] for r in rows} <= {0, 1}
    assert quality.fit_quality(docs, labels.where("false")).constant == 0.5
    assert quality.score_quality(nothing, fitted).count() == 0


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    found = QUERIES["op2_quality"](spark, MEDIUM).join(labels, "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95


def test_language(spark, docs, nothing):
    profiles = langid.fit_profiles(docs.where("lang is not null"))
    rows = langid.identify(docs, profiles).collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert langid.fit_profiles(nothing).names == []
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit_profiles(nothing)).collect()} == {"und"}
    codes, counts = langid.trigrams("Abc, abc")
    assert counts.sum() == 7 and len(codes) == 4


def test_language_held_out(spark):
    truth = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op6_language"](spark, MEDIUM).join(truth, "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97


def brute_likelihood(model, seq):
    alpha = model.start * model.emit[seq[0]]
    for c in seq[1:]:
        alpha = (alpha @ model.move) * model.emit[c]
    return math.log(alpha.sum())


def test_hmm_recursions():
    draw = np.random.default_rng(2)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    model = hmm.States(norm(draw.random(3), 0), norm(draw.random((3, 3)), 1), norm(draw.random((5, 3)), 0))
    seqs = [draw.integers(0, 5, n).astype(np.int32) for n in (1, 4, 7, 4)]
    assert np.allclose(hmm.forward(model, seqs), [brute_likelihood(model, s) for s in seqs])
    sums = hmm._empty(3, 5)
    hmm.expected(model, seqs, [True] * 4, sums)
    assert np.isclose(sums[2].sum(), 16) and np.isclose(sums[1].sum(), 12) and np.isclose(sums[0].sum(), 4)
    better = hmm.maximised(sums, np.full(5, 0.2), prior=0.0)
    better = hmm.States(sums[0] / 4, norm(sums[1], 1), better.emit)
    assert hmm.forward(better, seqs).sum() > hmm.forward(model, seqs).sum()


def test_language_model(docs, nothing):
    training = docs.where("doc_id % 2 = 0").select("text")
    counts = hmm.word_counts(training)
    classes, states = hmm.fit(training, counts, states=2, head=50, buckets=16, sample_iterations=2, iterations=1)
    c = Counter(w for r in training.collect() for w in hmm.tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    rows = hmm.score_texts(docs, counts, classes, states).collect()
    want = []
    for r in docs.collect():
        words = hmm.tokens(r["text"])
        logs = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)
        seq = classes.of(words)
        tail = sum(math.log10((c[w] + 1) / (classes.bucket_counts[k - len(classes.head)]
                   + classes.bucket_words[k - len(classes.head)] + 1))
                   for w, k in zip(words, seq) if k >= len(classes.head))
        score = brute_likelihood(states, seq) / math.log(10) + tail if len(seq) < 300 else None
        want.append((r["doc_id"], len(words), sum(c[w] > 0 for w in words), n, logs, score))
    key = lambda x: (x[0] is None, x[0] or 0)
    for got, exp in zip(sorted(map(tuple, rows), key=key), sorted(want, key=key), strict=True):
        assert got[:4] == exp[:4] and got[4] == pytest.approx(exp[4])
        assert exp[5] is None or got[5] == pytest.approx(exp[5])
    assert hmm.score_texts(nothing, counts, classes, states).count() == 0


def plain_counts(model, seqs, first):
    sums = [np.zeros(len(model.start)), np.zeros(model.move.shape), np.zeros(model.emit.shape)]
    for seq, opening in zip(seqs, first):
        start = model.start if opening else np.full(len(model.start), 1 / len(model.start))
        ahead, back = [start * model.emit[seq[0]]], [np.ones(len(model.start))]
        for c in seq[1:]:
            ahead.append((ahead[-1] @ model.move) * model.emit[c])
        for c in seq[:0:-1]:
            back.insert(0, model.move @ (model.emit[c] * back[0]))
        whole = ahead[-1].sum()
        sums[0] += ahead[0] * back[0] / whole * opening
        for t, c in enumerate(seq):
            sums[2][c] += ahead[t] * back[t] / whole
            if t:
                sums[1] += ahead[t - 1][:, None] * model.move * (model.emit[c] * back[t]) / whole
    return sums


def test_hmm_expectations_of_long_sequences():
    draw = np.random.default_rng(5)
    model = hmm.States(draw.dirichlet(np.ones(3)), draw.dirichlet(np.ones(3), 3), draw.dirichlet(np.ones(9), 3).T)
    seqs = [draw.integers(0, 9, n).astype(np.int32) for n in (1, 7, 8, 9, 17, 40, 40, 90)]
    first = [True, False, True, True, False, True, True, False]
    sums, space = hmm._empty(3, 9), hmm.Space()
    for some in (slice(0, 5), slice(5, 8)):  # arrays are used again, larger and smaller
        hmm.expected(model, seqs[some], first[some], sums, space)
    for got, want in zip(sums, plain_counts(model, seqs, first), strict=True):
        assert np.allclose(got, want, rtol=1e-10, atol=1e-12)
    assert np.allclose(hmm.forward(model, seqs), [brute_likelihood(model, x) for x in seqs])


def test_hmm_learns_from_all_texts_at_every_step(spark):
    words = ["sea", "Salt", "wave", "tide", "road", "stone", "dust", "wheel"]
    draw = np.random.default_rng(8)
    bodies = [" ".join(words[k] for k in draw.integers(0, 4, 6) + 4 * (i % 2)) for i in range(4_500)]
    bodies += [None, ""]
    training = spark.createDataFrame([(b,) for b in bodies], "text string").repartition(5)
    counts = hmm.word_counts(training)
    classes, states = hmm.fit(training, counts, states=2, head=6, buckets=4, sample_iterations=2, iterations=1)
    seqs = [classes.of(hmm.tokens(b)) for b in bodies]
    model = hmm.opening_states(classes, 2)
    for _ in range(3):
        model = hmm.maximised(plain_counts(model, seqs, [True] * len(seqs)), classes.shares())
    assert np.allclose(states.start, model.start) and np.allclose(states.move, model.move)
    assert np.allclose(states.emit, model.emit)


def test_words_split_in_bulk_are_the_plain_tokens(monkeypatch):
    monkeypatch.setattr(hmm, "SPLIT_BYTES", 40)
    bodies = [
        " \t Ab aB\n\x0b\x0c\r ab ", "", None, " ", "x", "\x1c \x1d\x85 \xa0\u2003y \x00 \x00", "ÄÖ İx ΑΣ 日本 é́",
        "abcdefgh" * 20 + " Z" + "z" * 70, "ab  cd ab", "", "tail"]
    column = pa.array(bodies, pa.string())
    parts = list(hmm._slices(column))
    assert len(parts) > 2 and [i for part in parts for i in range(len(bodies))[part]] == list(range(len(bodies)))
    got = []
    for part in parts:
        words, sizes = hmm._words(column[part])
        flat = iter(words.cast(pa.binary()).to_pylist())
        got += [[*(next(flat) for _ in range(n)), hmm.END] for n in sizes]
        assert next(flat, None) is None
    assert got == [hmm.tokens(b) for b in bodies]
    classes = hmm.Classes({hmm.END: 0, b"ab": 1}, np.array([1, 1]), 16, np.zeros(16, int), np.zeros(16, int), 2, 2)
    for words in got:
        assert classes.of(words).tolist() == [classes.head.get(w, 2 + zlib.crc32(w[-4:]) % 16) for w in words]


def test_class_sequences_are_dealt_in_bulk(monkeypatch):
    monkeypatch.setattr(hmm, "BATCH_TOKENS", 30)
    monkeypatch.setattr(hmm, "SORTED_TOKENS", 60)
    draw = np.random.default_rng(6)
    seqs = [draw.integers(0, 99, n).astype(np.uint16) for n in (3, 1, 25, 8, 16, 40, 7, 8, 9)]
    column = pa.array([s.tobytes() for s in seqs], pa.binary())
    batches = [column[:0], column[:4], column[4:]]
    found = (hmm._stretches(*hmm._sequences(c, np.dtype(np.uint16)), 8) for c in batches if len(c))
    got = Counter()
    for joined, at, lengths, first in hmm._near(found):
        got.update((joined[a: a + n].tobytes(), bool(f)) for a, n, f in zip(at, lengths, first, strict=True))
    assert got == Counter((s[i: i + 8].tobytes(), i == 0) for s in seqs for i in range(0, len(s), 8))


def test_words_outside_the_head_are_looked_up_without_a_sort(docs, nothing):
    counts = hmm.word_counts(docs.select("text"))
    classes, states = hmm.fit(docs.select("text"), counts, states=2, head=5, buckets=4, iterations=1, sample_iterations=0)
    scored = hmm.score_texts(docs, counts, classes, states)
    plan = scored._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin [w#" in plan and "SortMergeJoin [w#" not in plan


def test_packing_round_trip(spark, docs, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    pieces = packing.pack(docs, tokenizer_path()).collect()
    fill, ends = Counter(), {}
    for p in pieces:
        fill[p["sequence_id"]] += p["length"]
        ends[p["sequence_id"]] = max(ends.get(p["sequence_id"], 0), p["offset"] + p["length"])
    assert fill == ends
    assert all(n == 2048 or n & (n - 1) == 0 for n in fill.values())
    ids = {r["doc_id"]: np.array(
        whole.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4") for r in docs.collect()}
    for p in pieces:
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == zlib.crc32(own[p["start"]: p["start"] + p["length"]].tobytes())
    assert sum(p["length"] for p in pieces) == sum(len(ids[r["doc_id"]]) for r in docs.collect())
    assert packing.pack(nothing, tokenizer_path()).count() == 0


def test_packing_odd_words():
    words = packing.WordIds(tokenizer_path())
    for text in ("<|endoftext|> Foo", "A<|ENDOFTEXT|>b", "ΑΣ. ΣΑΣ, İx", "it's I'LL, a\x1cb \x85q", "é́ 12.5, ...", "日本, ª."):
        assert words(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids + [1]
