"""Scans, list ranking and the trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from pyspark.sql import functions as F
from shelfwise.llm import scans, trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, id double"


@pytest.mark.parametrize("parts", [1, 5, 12])
def test_scan_crosses_parts(spark, parts):
    draw = random.Random(parts)
    rows = [(draw.choice([1, 1, 1, 2, 3, 9]), i, draw.randint(-(2**62), 2**62)) for i in range(200)]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ordered = scans.in_order(df, "g", "i")
        found = scans.scan(ordered, "g", {"s": "v"}, {"p": "i"}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert ordered.rdd.getNumPartitions() == parts
    sums, last, wanted = defaultdict(int), {}, {}
    for g, i, v in sorted(rows):
        wanted[i] = ((sums[g] + 2**63) % 2**64 - 2**63, last.get(g))
        sums[g] += v
        last[g] = i
    assert {r["i"]: (r["s"], r["p"]) for r in found} == wanted


@pytest.mark.parametrize("order", ["along", "random"])
@pytest.mark.parametrize("method", ["segments", "doubling"])
def test_list_rank(spark, order, method):
    n, draw = 700, random.Random(4)
    ids = [3 * i for i in range(n)]
    if order == "random":
        draw.shuffle(ids)
    weight = [draw.randint(0, 9) for _ in range(n)]
    rows = [(ids[i], ids[i + 1] if i + 1 < n else -1, weight[i], 1) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, next long, w long, one long").repartition(4)
    found = (scans.pointer_doubling(df, ["w", "one"]) if method == "doubling"
             else scans.list_rank(df, ["w", "one"], rows_per_task=100, last_rows=20))
    wanted = {ids[i]: (sum(weight[:i]), i) for i in range(n)}
    assert {r["id"]: (r["w"], r["one"]) for r in found.collect()} == wanted


def test_join_hot_keeps_every_row(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    found = scans.join_hot(rows, table, "k", "n", hot=10)
    assert found.count() == 1000 and found.where("k = 7 and n <> 335 and id % 3 = 0").count() == 0


def brute(rows):
    """All result columns from the definition."""
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    # Ties of equal turns are all equal in the tests.
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c / 20) * 20
        made[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    words = {k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0 for k in members}
    out = []
    for k, ms in members.items():
        below = [x for x in members if x[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(c for c in ms if len(made[c]) == len(k)))
        has_child = {x[:-1] for x in members if x}
        out.append((min(ms), len(k), min(members[k[:-1]]) if k else None, len(ms),
                    sum(1 for x in members if x and x[:-1] == k), sum(x not in has_child for x in below),
                    sum((len(members[x]) - 1) * words[x] for x in below),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **kwargs):
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA).repartition(3)
    found = trie.prefix_trie(*trie.rebuilt(trie.turn_rows(df)))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                             "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_trie_equals_brute_force(spark):
    draw = random.Random(8)
    rows = []
    for c in [*range(0, 70), 100, -7, -40, -41, 2**40 + 3]:
        for t in range(draw.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, draw.choice(["user", None]), draw.choice(["a b", "a  b c", "", None, "a b"])))
    rows += [(5, None, "user", "first"), (None, 1, "user", "no conversation"), (3, 50, "u", "twice"), (3, 50, "u", "twice")]
    draw.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_long_conversation_and_long_text(spark):
    """One conversation holds most turns; many conversations begin alike and many are equal."""
    rows = [(40, t, "user", f"t{t % 7}" + " w" * (t % 11)) for t in range(1500)]
    rows += [(c, t, "user", f"t{t % 7}" + " w" * (t % 11)) for c in range(41, 60) for t in range(3)]
    rows += [(61, 0, "user", "long " * 50_000)]
    found = run(spark, rows)
    assert len(found) == len({(r[0], r[1]) for r in found})
    path = [r for r in found if r[0] == 40 and r[1] > 3]
    assert len(path) == 1497 and all(r[5] == 1 and r[6] == 0 for r in path)
    short = [r for r in rows if r[1] < 12 and not r[3].startswith("long")] + [(61, 0, "user", "long " * 10)]
    assert run(spark, short) == brute(short)


def test_same_role_and_text_borders(spark):
    """Role "ab" with text "c" is not role "a" with text "bc"."""
    rows = [(20, 0, "ab", "c"), (21, 0, "a", "bc"), (22, 0, "a:b", "c"), (23, 0, "a", "b:c")]
    assert run(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []


def test_many_members_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(c, 0, "user", "same") for c in range(0, 400, 20)] + [(c, 0, "u", f"{c}") for c in range(1, 20)]
    assert run(spark, rows) == brute(rows)
