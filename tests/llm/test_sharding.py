"""Shards against a plain heap over all groups."""

import heapq
import random
from collections import Counter, defaultdict

import pytest
from odd_tables import SMALL, docs, nothing  # noqa: F401

from pyspark.sql import functions as F
from shelfwise.llm import queries, sharding


def plain(sizes, shards):
    """Loads of the shards when every size, largest first, goes to the least loaded."""
    heap = [(0, i) for i in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, i = heap[0]
        heapq.heapreplace(heap, (load + size, i))
    return sorted(load for load, _ in heap)


@pytest.mark.parametrize("seed", range(5))
def test_deal_is_the_heap(seed):
    draw = random.Random(seed)
    loads = [draw.randint(0, 5000) for _ in range(8)]
    for n, size in ((0, 7), (3, 900), (17, 900), (1000, 13), (999, 1)):
        heap, counts = [(x, i) for i, x in enumerate(loads)], [0] * 8
        heapq.heapify(heap)
        for _ in range(n):
            load, i = heap[0]
            counts[i] += 1
            heapq.heapreplace(heap, (load + size, i))
        assert sharding.deal(loads, n, size) == counts


def test_rounds_give_each_shard_its_count():
    counts = [5, 0, 9, 9, 2]
    got, phases = Counter(), sharding.rounds(counts, [0] * 5)
    for rank in range(sum(counts)):
        start, members = [p for p in phases if p[0] <= rank][-1]
        got[members[(rank - start) % len(members)]] += 1
    assert [got[i] for i in range(5)] == counts


def check(rows, shards=8):
    """Groups together, slots gapless; the loads of the shards."""
    of_text, slots, loads = defaultdict(set), defaultdict(list), [0] * shards
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        assert (r["law"], r["grown_shard"]) == ("bytes", None)
        of_text[r["text"] or ""].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in of_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sorted(loads)


def groups_of(rows):
    sizes = Counter()
    for r in rows:
        sizes[r["text"] or ""] += r["size"]
    return list(sizes.values())


def test_equals_plain_schedule(docs):  # noqa: F811
    """In a small table every group is above the limit, so sizes are exact."""
    rows = sharding.shard_by_size(docs).collect()
    assert len(rows) == docs.count()
    large = [s for s in groups_of(rows)]
    limit = sum(large) // (8 * sharding.UNITS)
    assert check(rows) == plain(large, 8) or min(large) <= limit
    assert max(check(rows)) - max(plain(large, 8)) <= limit + 1


def test_classes_stay_near(spark):
    """Few units, so that most groups go by size class."""
    draw = random.Random(5)
    texts = ["x" * draw.randint(1, 400) + str(i) for i in range(3000)] + ["copy"] * 2000
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    rows = df.withColumn("size", (F.octet_length("text") + 1).cast("bigint")).withColumn(
        "_group", F.unhex(F.sha2("text", 256)))
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")).cache()
    found = sharding.assign(groups, 8, units=4, bits=4).join(groups.select("_group", "_bytes"), "_group")
    loads = [r["b"] for r in found.groupBy("shard").agg(F.sum("_bytes").alias("b")).collect()]
    assert found.count() == 3001 and len(loads) == 8
    assert max(loads) - min(loads) <= 400
    assert check(sharding.shard_by_size(df).collect())[0] > 0


def test_hot_text_and_own_groups(spark):
    rows = [(i, "same" if i % 3 else f"t{i}", i % 5) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host int")
    found = sharding.shard_by_size(df, group=F.col("host"), keep=["doc_id", "host"], shards=3)
    assert found.columns[:2] == ["doc_id", "host"]
    assert {r["n"] for r in found.groupBy("host").agg(F.count_distinct("shard").alias("n")).collect()} == {1}
    assert found.groupBy("shard").count().count() == 3
    check(sharding.shard_by_size(df).collect())


def test_empty(nothing):  # noqa: F811
    assert sharding.shard_by_size(nothing).count() == 0


def test_query(spark):
    found = queries.op11_sharding(spark, SMALL)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = found.join(texts, "doc_id").collect()
    assert len(rows) == texts.count()
    loads = check(rows)
    assert loads[-1] - plain(groups_of(rows), 8)[-1] <= sum(loads) // (8 * sharding.UNITS) + 1
