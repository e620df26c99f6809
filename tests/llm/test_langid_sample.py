from shelfwise.llm import langid


def test_rare_language_keeps_its_prototype(spark):
    """Above ``max_training`` rows a language with few texts is still learned."""
    rows = [(i, "en", "the quick brown fox and the dog") for i in range(2_000)]
    rows += [(10_000 + i, "fi", "nopea ruskea kettu ja koira") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    assert langid.fit_profiles(docs, max_training=1).names == ["en", "fi"]
    assert langid.fit_profiles(docs, max_training=20).names == ["en", "fi"]
