from lodestone.functions.register import register


def test_sql_names(spark):
    register(spark, "hash:32")
    spark.createDataFrame([("a", "# T\n\nThe API limits queries. Second one."), ("b", None)], "source string, text string").createOrReplaceTempView("docs_for_sql")
    got = spark.sql("SELECT d.source, c.* FROM docs_for_sql d, LATERAL lodestone_chunk(d.text, 800, 150) c").collect()
    assert [tuple(r) for r in got] == [("a", 0, "T", "The API limits queries. Second one.")]
    row = spark.sql("SELECT lodestone_tokens(text) t, lodestone_sentences(text) s, size(lodestone_embed(text)) e, lodestone_html('<title>x</title><p>y').markdown h FROM docs_for_sql ORDER BY source").collect()
    assert row[0]["t"] == ["t", "api", "limit", "query", "second", "one"] and len(row[0]["s"]) == 2 and row[0]["e"] == 32 and row[0]["h"] == "y" and row[1]["t"] == []
