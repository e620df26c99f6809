"""Operators without SQL against plain versions written from their definitions."""

import hashlib
import re
from itertools import product

import numpy as np
import pytest
from odd_tables import docs, nothing  # noqa: F401

from shelfwise.llm import langid, packing, quality, queries


def test_pairwise_weights_against_gradient_steps():
    """Newton steps reach what many small gradient steps on all the same pairs reach."""
    draw = np.random.default_rng(2)
    good, bad = draw.normal(0.6, 1, (40, 5)), draw.normal(0, 1, (30, 5))
    found = quality.pairwise_weights(good, bad, 500)
    again = np.random.default_rng(7)
    pairs = good[again.integers(40, size=500)] - bad[again.integers(30, size=500)]
    w = np.zeros(5)
    for _ in range(40_000):
        grad = np.zeros(5)
        p = 1 / (1 + np.exp(pairs @ w))
        grad = (pairs * p[:, None]).mean(axis=0) - quality.RIDGE * w
        w += 0.1 * grad
    assert found == pytest.approx(w, abs=1e-4)


def test_quality_ranks_and_threshold():
    draw = np.random.default_rng(4)
    y = draw.random(400) < 0.7
    x = draw.normal(0, 1, (400, 4)) + 1.5 * y[:, None]
    model = quality.fit_arrays(x, y)
    raw, scores = model.raw(x), model.scores(x)
    assert (np.argsort(raw, kind="stable") == np.argsort(scores, kind="stable")).all()
    wins = np.mean([a > b for a, b in product(raw[y], raw[~y])])
    assert wins > 0.9
    assert ((scores >= model.cut) == (raw >= model.threshold - 1e-12)).all()
    assert abs((raw >= model.threshold).mean() - y.mean()) <= 1 / 400 + 1e-9  # the score quantile


def plain_vector(text, book):
    """Bind, permute and bundle the letter vectors of every trigram, one by one."""
    folded = " " + " ".join(re.findall(r"[a-zé]+", text.lower())) + " "
    letter = lambda c: book.letter_vector(0 if c == " " else ord(c)).astype(float)
    total = np.zeros(book.dimensions)
    for a, b, c in zip(folded, folded[1:], folded[2:]):
        total += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    return total / np.sqrt((total**2).sum())


def test_language_profiles_by_loops(spark):
    rows = [(0, "aa", "the cat, the dog"), (1, "aa", "The THEN that"), (2, "bb", "été élan 12 vélo"), (3, "bb", "île é"), (4, "cc", "zz zy yz")]
    rows = [(i, lang, t.replace("î", "i")) for i, lang, t in rows]
    model = langid.fit_profiles(spark.createDataFrame(rows, "doc_id long, lang string, text string"), dimensions=256)
    book = langid.Codebook(256)
    made = []
    for name in ("aa", "bb", "cc"):
        v = sum(plain_vector(t, book) for _, lang, t in rows if lang == name)
        made.append(v / np.sqrt((v**2).sum()))
    made = np.array(made) - np.mean(made, axis=0)
    made /= np.sqrt((made**2).sum(axis=1, keepdims=True))
    assert model.names == ["aa", "bb", "cc"] and model.rows == pytest.approx(made, abs=1e-5)
    asked = spark.createDataFrame([(9, "that dog", "x"), (10, "élan vélo", "y"), (11, "12 !", None), (12, None, None)],
                                  "doc_id long, text string, score string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(asked, model).collect()}
    for key, text in ((9, "that dog"), (10, "élan vélo")):
        cosines = made @ plain_vector(text, book)
        odds = np.exp(langid.SHARPNESS * (cosines - cosines.max()))
        assert got[key][0] == model.names[int(cosines.argmax())]
        assert got[key][1] == pytest.approx(1 / odds.sum(), abs=1e-4)
    assert got[11][0] == got[12][0] == "und"


def test_every_letter_beside_a_plain_one(spark):
    """Ids word by word are the tokenizer's own for each letter there is."""
    words = packing.WordIds(queries.tokenizer_path())
    texts = [f"a{chr(cp)}b" for cp in range(0x250000 >> 4) if chr(cp).isalpha()]
    texts += [f"a{chr(cp)}b" for cp in range(0x10000, 0x2FA20) if chr(cp).isalpha()][::7]
    wanted = words.whole(texts)
    wrong = [t for t, ids in zip(texts, wanted) if words(t)[:-1].tolist() != ids]
    assert not wrong


def pieces(text):
    return set(re.findall(r"[^\n]{0,80}\n|[^\n]{1,80}", text))


def test_fingerprint_query(spark, docs, nothing, tmp_path):  # noqa: F811
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op10_fingerprints(spark, str(tmp_path)).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    wanted = []
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        wanted.append((str(key), len(text), hashlib.sha256(edited.encode()).hexdigest(),
                       round(likeness(pieces(text), pieces(edited)), 9), round(likeness(pieces(text), pieces(after)), 9)))
    got = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found]
    assert sorted(got) == sorted(wanted)
    of_text = {}
    for r, t in ((r, t) for r in found for k, t in rows if k == r["doc_id"] and len(t) == r["n_chars"]):
        of_text.setdefault(t, set()).add(r["fingerprint"])
    assert all(len(v) == 1 for t, v in of_text.items() if sum(t == x for _, x in rows) > 1)
    nothing.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op10_fingerprints(spark, f"{tmp_path}/none").count() == 0
