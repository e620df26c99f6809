"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (
    ann, hmm, iblt, langid, mixing, packing, passages, quality, sharding, simhash, successors, suffixes,
    tagpaths, trie, whitening,
)
from shelfwise.llm.common import fold, table, texts, written


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(fold(F.col("doc_id"), 5) != 0)
    model = quality.fit_quality(docs, labels)
    return quality.score_quality(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mixing.mix_sources(docs, keep=["doc_id"]).select(
        "doc_id", "size", "source_size", "target", "taken")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return simhash.near_duplicates(docs, keep=["doc_id"]).select(
        "doc_id", "fingerprint", "component_id")


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    profiles = langid.fit_profiles(docs.where(fold(F.col("doc_id"), 4) != 2))
    return langid.identify(docs.select("doc_id", "text"), profiles).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffixes.cut_repeats(docs, words=passages.WORDS).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "n_passage_words")


def op8_language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    training = docs.where(fold(F.col("doc_id"), 7) != 2).select("text")
    counts = hmm.word_counts(training)
    classes = hmm.find_classes(counts)
    rows = hmm.read_texts(docs, classes)
    states = hmm.fit_states(rows.where(fold(F.col("k"), 7) != 2).select("s"), classes)
    return hmm.score_read(rows, counts, classes, states).select(
        "doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known",
        "train_tokens", "base_score", "score")


def op9_articles(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return tagpaths.extract_articles(pages).select("page_id", "url", "text", "n_chars")


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", texts(F.col("text")).alias("text"))
    rows = successors.with_next(
        docs.withColumn("keys", iblt.paragraphs(F.col("text"))),
        "doc_id", F.md5(F.col("text").cast("binary")), ["text", "keys"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    found = rows.withColumn("edited", edited).select(
        "doc_id", n.cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "keys", "next_keys", iblt.paragraphs(F.col("edited")).alias("edited_keys"),
    )
    found = written(found.withColumn("id", F.monotonically_increasing_id()).withColumns({
        "fingerprint": iblt.base_fingerprint(F.col("keys")),
        "edited_fingerprint": iblt.base_fingerprint(F.col("edited_keys")),
    }))
    pairs = found.select("id", F.col("keys").alias("left"), F.posexplode(
        F.array("edited_keys", "next_keys")).alias("kind", "right"))
    near = iblt.likeness(pairs).groupBy("id").agg(
        F.max(F.when(F.col("kind") == 0, F.col("likeness"))).alias("near_edited"),
        F.max(F.when(F.col("kind") == 1, F.col("likeness"))).alias("near_next"))
    return found.join(near, "id").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        "near_edited", "near_next")


def op11_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    crc = F.crc32(texts(F.col("text")).cast("binary"))
    found = sharding.shard_by_size(docs.withColumn("text_crc32", crc), keep=["doc_id", "text_crc32"])
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(*trie.rebuilt(trie.turn_rows(table(spark, folder, "conversations"))))


QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_language": op6_language,
    "op7_suffixes": op7_suffixes,
    "op8_language_model": op8_language_model,
    "op9_articles": op9_articles,
    "op10_fingerprints": op10_fingerprints,
    "op11_sharding": op11_sharding,
    "op12_whitening": op12_whitening,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL = {
    "op3_mixing": f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(text, '')) AS tie,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 6))::BIGINT
           % greatest(1, (SELECT (count(*) + {mixing.BLOCK_ROWS - 1}) // {mixing.BLOCK_ROWS} FROM documents)) AS sub
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, 3 * source_size AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS rank,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sizes
), walked AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(cap) OVER before, 0) AS capped_size, coalesce(sum(weight) OVER before, 0) AS capped_weight
  FROM ranked WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, cap * (weights - capped_weight) <= (total - capped_size) * weight AS capped FROM walked
), targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE ELSE weight * (
           (total - coalesce(sum(cap) FILTER (capped) OVER (), 0))::DOUBLE
           / (weights - coalesce(sum(weight) FILTER (capped) OVER (), 0))::DOUBLE) END AS target
  FROM marked
), stepped AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN round(t.target / t.source_size * 16777216)::BIGINT ELSE 0 END AS units,
         row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size)), substr(bin(size), 1, 4), sub, size, doc_id, tie) AS place
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), crossed AS (
  SELECT *, place * units + ('0x' || substr(md5(coalesce(source, '')), 1, 6))::BIGINT AS upto FROM stepped
)
SELECT doc_id, size, source_size, target, ((upto >> 24) - ((upto - units) >> 24)) * size AS taken FROM crossed
""",
    "op13_prefix_trie": """
WITH ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(4294967295::BIGINT, list_reduce(
           [4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
           lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
             lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM ordered)
), parts AS (
  SELECT c.conv_id, 0 AS part, o.place, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.base AND o.place < c.h
  UNION ALL
  SELECT c.conv_id, 1, o.place, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.place >= c.h
), turns AS (
  SELECT conv_id, text, sha256(length(role) || ':' || role || ':' || text) AS digest,
         row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth
  FROM parts
), paths AS (
  SELECT conv_id, depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path,
         length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM turns
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), lengths AS (
  SELECT conv_id, max(depth) AS n FROM paths GROUP BY conv_id
), nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(words) AS own,
         string_agg(CASE WHEN depth = n THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends
  FROM paths JOIN lengths USING (conv_id) GROUP BY path
), linked AS (
  SELECT c.*, p.conv_id AS parent_conv_id
  FROM nodes c LEFT JOIN nodes p ON c.depth > 0 AND p.path = c.path[:(c.depth - 1) * 64]
), children AS (
  SELECT path[:(depth - 1) * 64] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), subtrees AS (
  SELECT up.path, sum(w.own)::BIGINT AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
  FROM nodes w LEFT JOIN children k USING (path) JOIN paths up ON up.conv_id = w.conv_id AND up.depth <= w.depth
  GROUP BY up.path
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM linked LEFT JOIN children USING (path) JOIN subtrees USING (path)
""",
}
