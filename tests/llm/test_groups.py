"""Neighbours, mixing, near-duplicates, repeats, sketches, articles and the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from compare import connect, difference
from odd_tables import SMALL, docs, nothing  # noqa: F401
from shelfwise.llm import ann, iblt, mixing, simhash, successors, suffixes, tagpaths
from shelfwise.llm.common import texts
from shelfwise.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("key", sorted(SQL))
def test_same_as_sql(spark, key):
    assert difference(QUERIES[key](spark, SMALL), connect(SMALL), SQL[key]) is None


def test_neighbours(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(600, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(40)]
    odd = [(2001, None), (2002, [0.0] * 8), (2003, [1.0] * 7 + [None]), (2004, [float("nan")] * 8),
           (2005, [1.0, 2.0]), (None, x[1].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 100 == 0, hot_bucket=50).collect()
    ids = np.array([r[0] for r in rows])
    full = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = ann.exact(full[ids == q][0], full)
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, 11))
        assert all(s == d[ids == v][0] for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(ids[best].tolist()))
        total += 10
    assert hits / total >= 0.9
    few = ann.search(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3]
    assert ann.search(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_mixing_rules(docs, nothing):
    rows = mixing.mix_sources(docs, block_rows=5).collect()
    assert len(rows) == docs.count()
    taken, target = Counter(), {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
        target[r["source"]] = (r["target"], r["source_size"])
    assert sum(t for t, _ in target.values()) == pytest.approx(sum(s for _, s in target.values()))
    assert all(t <= 3 * s + 1e-6 for t, s in target.values())
    again = sorted(map(str, mixing.mix_sources(docs.repartition(2), block_rows=5).collect()))
    assert again == sorted(map(str, rows))
    assert mixing.repeated(mixing.mix_sources(docs)).count() == sum(
        r["copies"] for r in mixing.mix_sources(docs).collect())
    assert mixing.mix_sources(nothing).count() == 0


def test_fingerprint_links(spark, docs, nothing):
    draw = np.random.default_rng(6)
    base = draw.integers(-2**63, 2**63, 60)
    flips = [int(b) ^ (1 << int(draw.integers(0, 62))) ^ (1 << int(draw.integers(0, 62))) for b in base for _ in range(4)]
    chain = [0]
    for i in range(40):
        chain.append(chain[-1] ^ (1 << (i % 60)))
    fps = sorted({*map(int, base), *flips, *chain, -1, -2})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    x = np.array(fps).view(np.uint64)
    root = np.arange(len(x))
    for i in range(len(x)):
        near = np.bitwise_count(x ^ x[i]) <= 3
        root[np.isin(root, root[near])] = root[near].min()
    for hot in (20_000, 8):
        found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, hot_cell=hot)).collect()}
        groups = defaultdict(set)
        for f in fps:
            groups[found.get(f, f)].add(f)
        want = defaultdict(set)
        for f, r in zip(fps, root.tolist()):
            want[r].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    empty = [r for r in rows if not (r["text"] or "").split()]
    assert {r["fingerprint"] for r in empty} == {"0" * 16} and len({r["component_id"] for r in empty}) == 1
    assert simhash.near_duplicates(nothing).count() == 0


def plain_fingerprint(text):
    """Bit by bit, from the definition."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "").encode())
    if not words:
        return 0
    shingles = [b" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(texts):
    """The smallest place linked to each text, by comparing all pairs again and again."""
    prints = [plain_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    near = [[j for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 3] for i in range(len(texts))]
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(near):
            least = min(root[j] for j in js)
            changed |= least < root[i]
            root[i] = least
    return prints, root


def test_fingerprints_and_kept_rows(spark, docs, nothing):
    rows = sorted((tuple(r) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    prints, root = plain_groups([r[1] for r in rows])
    found = Counter((r["doc_id"], r["text"], r["fingerprint"]) for r in simhash.near_duplicates(docs).collect())
    assert found == Counter((r[0], r[1], f"{p:016x}") for r, p in zip(rows, prints))
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter(rows[i] for i in set(root))
    assert simhash.first_of_each(nothing).count() == 0


def test_no_row_is_lost_for_its_key(spark):
    """Four different texts under the keys null, 1, 1 and 2, and copies."""
    make = lambda n: " ".join(f"w{n}x{i}" for i in range(60))
    rows = [(None, make(1)), (1, make(2)), (1, make(3)), (2, make(4)), (2, make(4)), (7, make(4)), (None, make(2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, simhash.first_of_each(df).collect())) == Counter(rows[:4])


def covered(bodies, length):
    seen = Counter(b[i: i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        spans = suffixes.merged([(i, i + length) for i in range(len(b) - length + 1) if seen[b[i: i + length]] > 1])
        kept, at = b"", 0
        for x, y in spans:
            kept, at = kept + b[at:x], y
        out.append((len(b), len(spans), hashlib.sha256(kept + b[at:]).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_against_brute_force(docs, nothing, hot):
    for length in (400, 100):
        rows = suffixes.cut_repeats(docs, length=length, hot_lead=hot).collect()
        got = sorted((r["n_bytes"], r["n_spans"], r["kept_sha256"]) for r in rows)
        assert got == sorted(covered([(r["text"] or "").encode() for r in docs.collect()], length))
    assert suffixes.cut_repeats(nothing).count() == 0


def passage_words(bodies, words):
    """Words in runs of so many words that another row holds too."""
    held = [b.split() for b in bodies]
    runs = [[tuple(w[i: i + words]) for i in range(len(w) - words + 1)] for w in held]
    rows_of = Counter(r for own in runs for r in set(own))
    return [len({i + k for i, r in enumerate(own) if rows_of[r] > 1 for k in range(words)}) for own in runs]


def passage_rows():
    draw = random.Random(11)
    make = lambda n: [draw.choice("abcdefg") + str(draw.randint(0, 99)) for _ in range(n)]
    short, other = make(51), make(75)
    texts = [make(30) + p + make(45) for p in (short, short, short[:-1], other, other[3:], other[:60], other[12:70]) for _ in (0, 1)]
    texts += [short, short + short, make(5) + short + make(7) + short, make(20) + other + other + other, make(10), []]
    alone = make(60)
    texts += [alone + make(3) + alone, make(70)]
    rows = [" ".join(t) for t in texts]
    rows += ["\n\t".join(texts[0]), rows[-1], rows[-1], "\u00e9 " * 120, "\u00e9\u3000" * 70, None]
    return list(enumerate(rows))


@pytest.mark.parametrize("words", [51, 12])
def test_passage_words_against_brute_force(spark, docs, nothing, words):
    own = spark.createDataFrame(passage_rows(), "doc_id bigint, text string").repartition(3)
    for df in (own, docs):
        rows = suffixes.cut_repeats(df, words=words).collect()
        texts = [(r["text"] or "").encode() for r in df.collect()]
        got = sorted((r["n_bytes"], r["n_passage_words"]) for r in rows)
        assert got == sorted(zip(map(len, texts), passage_words(texts, words)))
        bare = suffixes.cut_repeats(df).drop("n_passage_words").collect()
        same = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
        assert Counter(tuple(r[c] for c in same) for r in rows) == Counter(tuple(r[c] for c in same) for r in bare)
    assert suffixes.cut_repeats(nothing, words=words).count() == 0


def test_op7_tells_passages_below_its_length(spark, tmp_path):
    """A passage of 51 words and 254 bytes in two rows: nothing is removed, and both rows say so."""
    make = lambda n, k: " ".join(f"{n}{i:03d}" for i in range(k))
    passage = make("p", 51)
    rows = [(1, f"{make('a', 40)} {passage} {make('b', 40)}"), (2, f"{passage} {make('c', 90)}"), (3, make("d", 200)), (4, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op7_suffixes"](spark, str(tmp_path)).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3, 4)] == [0] * 4
    assert [got[i]["n_passage_words"] for i in (1, 2, 3, 4)] == [51, 51, 0, 0]


def test_multikey_sort():
    draw = np.random.default_rng(8)
    rows = draw.integers(0, 2, (200, 24)).astype(np.uint8)
    order, common = suffixes.multikey_sort(rows.view(">u8").astype(np.uint64))
    lines = [rows[i].tobytes() for i in order]
    assert lines == sorted(lines)
    for a, b, n in zip(lines, lines[1:], common[1:]):
        same = next((i for i in range(24) if a[i] != b[i]), 24)
        assert same == n


def test_sketch_differences(spark):
    draw = np.random.default_rng(9)
    rows = []
    for i in range(60):
        a = draw.integers(-2**62, 2**62, draw.integers(0, 50)).tolist()
        b = a[: len(a) // 2] + draw.integers(-2**62, 2**62, draw.integers(0, 30)).tolist()
        rows.append((i, 0, a, b))
    df = spark.createDataFrame(rows, "id bigint, kind int, left array<bigint>, right array<bigint>")
    for cells in (1.5, 0.4):  # the small sketches fail first and are tried again
        got = {r["id"]: r["likeness"] for r in iblt.likeness(df, cells=cells, rounds=8).collect()}
        for i, _, a, b in rows:
            u = set(a) | set(b)
            assert got[i] == pytest.approx(len(set(a) & set(b)) / len(u) if u else 1.0)


def test_next_in_order(docs):
    rows = docs.select("doc_id", texts(F.col("text")).alias("text"))
    got = successors.with_next(rows, "doc_id", F.md5(F.col("text").cast("binary")), ["text"], block_rows=4)
    key = lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), hashlib.md5(r["text"].encode()).hexdigest())
    order = sorted(rows.collect(), key=key)
    want = Counter((r["doc_id"], r["text"], n["text"]) for r, n in zip(order, order[1:] + order[:1]))
    assert Counter(map(tuple, got.collect())) == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head>
<body><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="ad banner">Buy this now, it is cheap.</div>
<article><h1>A &amp; B</h1><p>First   paragraph, with <b>bold</b> text<br>and a break. It goes on for a while.
<p>Second &eacute; paragraph, also of some length, so that it counts.</p><ul><li>item one</li></ul></article>
<div id="comments"><p>Nice article! I liked it, really, very much.</p></div><footer>&copy; us</footer></body></html>"""


def test_articles(spark):
    want = ("A & B\nFirst paragraph, with bold text and a break. It goes on for a while.\n"
            "Second é paragraph, also of some length, so that it counts.\nitem one")
    assert tagpaths.main_text(PAGE) == want
    rows = [(1, "u", PAGE, "old"), (2, None, None, None), (3, "u", "", ""), (4, "u", "<p>open <b>tag", "x"), (5, "u", "<", "x")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in tagpaths.extract_articles(df).collect()}
    assert got[1] == (want, len(want)) and got[2] == got[3] == ("", 0) and got[4] == ("open tag", 8)
    assert tagpaths.extract_articles(df.where("false")).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for (name, stage), last in zip(corpus_pipeline.STAGES, [False] * 4 + [True]):
        before, docs = docs, stage(spark, docs, SMALL).cache()
        assert docs.columns == before.columns or last
        if name == "quality":
            labels = spark.read.parquet(f"{SMALL}/labels.parquet")
            assert docs.join(labels.where("quality = 0"), "doc_id").count() == 0
            assert before.join(labels.where("quality = 1"), "doc_id").count() == docs.join(
                labels.where("quality = 1"), "doc_id").count()
        elif name == "near_duplicates":
            assert docs.count() == docs.select("text").distinct().count() <= before.count()
            rows = sorted((tuple(r) for r in before.collect()), key=lambda r: r[0])
            _, root = plain_groups([r[1] for r in rows])
            assert Counter(map(tuple, docs.collect())) == Counter(rows[i] for i in set(root))
        elif name == "repeated_passages":
            bodies = [(r["text"] or "").encode() for r in before.collect()]
            want = sorted(x[2] for x in covered(bodies, corpus_pipeline.PASSAGE_BYTES))
            assert sum(len(b) for b in bodies) >= docs.agg(F.sum(F.octet_length("text"))).first()[0]
            assert len(want) == docs.count()
        elif name == "mixing":
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        assert docs.count() > 0
