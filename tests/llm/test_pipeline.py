"""Each stage of the pipeline against brute force on its own input, and the registered queries."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from parchwork.llm import decontamination, suffixes
from test_pairs_and_repeats import brute_near

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), "test")
        out.append((before.collect(), docs.collect(), docs.columns))
    return out


def test_stages(stages, spark):
    assert all(columns == COLUMNS for _, _, columns in stages[:-1])
    labels = {i: (q, t) for i, q, t in duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{DATA}/labels.parquet'").fetchall()}
    before, after, _ = stages[0]
    kept = {r.doc_id for r in after}
    good = [r.doc_id for r in before if labels.get(r.doc_id) == (1, 0)]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert not any(i in kept for i, (q, _) in labels.items() if q == 0)
    before, after, _ = stages[1]
    want = {i for i, (_, _, keep) in brute_near([(r.doc_id, r.text) for r in before], width=5).items() if keep}
    assert {r.doc_id for r in after} == want
    before, after, _ = stages[2]
    brute = suffixes.brute_force({r.doc_id: r.text.encode() for r in before})
    assert {r.doc_id: r.text for r in after} == {i: k.decode("utf-8", "ignore") for i, (n, _, k) in brute.items() if k or not n}
    before, after, _ = stages[3]
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not decontamination.brute_force(r.text, items)[1]}
    before, after, _ = stages[4]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_rows_of_one_id_are_judged_apart(spark, documents):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(5, a + " end"), (1, a), (1, a), (2, a + " more"), (2, b), (None, a), (None, a), (9, b), (0, b + " end"), (7, None), (7, None)]
    docs = documents(rows)
    left = corpus_pipeline.distinct(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in left.collect())) == sorted([(1, a), (0, b + " end"), (0, a), (0, a), (7, ""), (7, "")])
    # the clean row of an id stays where another of it is a copy
    left = corpus_pipeline.distinct(spark, documents([(1, a), (2, a), (2, b)]), "")
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, a), (2, b)]


def test_leaks_of_items_without_an_id(spark, documents, tmp_path):
    passage = " ".join(f"w{k}" for k in range(12))
    spark.createDataFrame([(None, passage), (None, None), (3, "x y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.without_leaks(spark, documents([(1, f"so {passage} so"), (2, "clean"), (3, "X, y"), (4, None)]), str(tmp_path))
    assert {r.doc_id for r in left.collect()} == {2, 4}


def test_registered(spark):
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", ["op1_decontamination", "op5_near_duplicates", "op6_chat", "op7_top_k", "op11_conversation_repair"])
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, rel = __spark_entry__.queries()[name](spark, DATA), con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(r) for r in df.select(columns).collect()) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


def test_stages_take_odd_rows_and_empty_tables(spark, documents, tmp_path):
    """Null, empty, very long and repeated texts, null ids and columns of names that operators use."""
    long = " ".join(f"word{k}" for k in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (4, long), (None, "no id here"), (None, None), (6, "a b c"), (7, "short text of some words")]
    spark.createDataFrame([(1, 1, 0), (4, 1, None), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "not in any of them"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, empty = documents(rows), documents([])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.count() == (8 if name == "near_duplicates" else len(rows)), name
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    packed = corpus_pipeline.packed(spark, docs, "").collect()
    assert sum(r.start == 0 for r in packed) == len(rows) and corpus_pipeline.packed(spark, empty, "").count() == 0
