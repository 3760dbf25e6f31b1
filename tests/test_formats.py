import pytest
from pyspark.sql import functions as F

from parchwork.plans.session import fresh_path, materialize
from parchwork.sources import docx
from parchwork.streaming import resume

TEXT = "# Title\n\nPlain **bold** and *it* text[^1]\n\n1. first\n- dot\n\n| a | b |\n|---|---|\n| 1 |\n\n---PAGE_BREAK---\n\nكلمة عربية 12 word\n\n[^1]: the note"


def test_docx_round_trip():
    d = docx.parse(docx.compose(TEXT))
    assert d.title == "Title" and d.pages == 2 and d.notes == {"1": "the note"}
    assert d.tables == [[["a", "b"], ["1", ""]]]
    assert "**bold**" in d.markdown and "*it*" in d.markdown and " [^1]" in d.markdown and "1. first" in d.markdown and "* dot" in d.markdown
    assert docx.compose(TEXT) == docx.compose(TEXT)
    with pytest.raises(ValueError):
        docx.parse(b"no archive")


def test_docx_source(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx.compose(TEXT))
    (tmp_path / "b.docx").write_bytes(b"broken")
    rows = {r.path.rsplit("/", 1)[1]: r for r in docx.read_docx(spark, str(tmp_path)).collect()}
    assert rows["a.docx"].title == "Title" and rows["a.docx"].error is None
    assert rows["b.docx"].error and rows["b.docx"].markdown is None


def test_docx_column(spark):
    df = spark.createDataFrame([(1, TEXT, True), (2, None, False)], "id int, markdown string, rtl boolean")
    rows = docx.with_docx(df).orderBy("id").collect()
    assert docx.parse(bytes(rows[0].docx)).title == "Title" and docx.parse(bytes(rows[1].docx)).markdown == ""


def test_stream_resumes_without_loss_or_repeats(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).withColumnRenamed("id", "doc_id").write.mode("append").parquet(source)
        resume.stream_documents(spark, source, "doc_id long", lambda d: d.withColumn("twice", F.col("doc_id") * 2), target, state).awaitTermination(60)
    rows = spark.read.parquet(target).select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == list(range(20))


def test_materialize_ends_lineage(spark):
    df = materialize(spark.range(5), "test")
    assert df.count() == 5 and "parquet" in df._jdf.queryExecution().toString().lower()
    assert fresh_path(spark, "a") != fresh_path(spark, "a")
