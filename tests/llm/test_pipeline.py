import corpus_pipeline as C
from featlake.llm import queries


def test_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = docs.count()
    for name, step in C.STAGES[:-1]:
        out = step(spark, docs, d)
        assert out.columns == docs.columns, name
        docs = C.stage(out, name)
        n = docs.count()
        assert 0 < n <= before
        before = n
    pieces = C.STAGES[-1][1](spark, docs, d)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    text = docs.select("text").toPandas().text
    assert text.nunique() == len(text) and not text.str.contains("@mail").any()


def test_labelled_clean_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    kept = C.quality_filter(spark, docs, d).join(labels, "doc_id").groupBy("quality").count().collect()
    share = {r["quality"]: r["count"] for r in kept}
    assert share[1] >= 0.97 * labels.filter("quality = 1").count() and share.get(0, 0) <= 0.2 * labels.filter("quality = 0").count()


def test_every_query_is_there():
    assert [f"op{n}_" for n in range(1, 11)] == sorted((k[: k.index("_") + 1] for k in queries.QUERIES), key=lambda x: int(x[2:-1]))


def test_extra_columns_with_clashing_names(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30)
    odd = d.selectExpr("*", "'x' AS h", "1 AS w", "2 AS pos", "3 AS score", "'y' AS fp", "4 AS block", "5 AS e", "6 AS k", "7 AS b")
    for name, step in C.STAGES[1:]:
        out = step(spark, odd, "/root/testdata/sf0.01")
        assert out.count() > 0, name
