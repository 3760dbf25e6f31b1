import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchwork.functions import images, presentation
from parchwork.functions import text as X
from parchwork.functions.dialect import rewrite
from parchwork.operators import batch, segment


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "text string").select(f(F.col("text"))).first()[0]


@pytest.mark.parametrize("size", [100_000])
def test_long_runs_of_dots_need_no_stack(spark, size):
    began = time.time()
    for text in ("." * size, ". " * size, "\n.....".join([""] * size)):
        got = one(spark, text, lambda t: rewrite(t, X.DOTS))
        assert len(got) < 20
    assert one(spark, "." * size, X.has_dot_flood)
    assert time.time() - began < 60


def test_cleaning_is_idempotent(spark):
    text = "a......\n\n\n\nb<br>c  \n---PAGE_BREAK---\n12\nd"
    once = one(spark, text, X.clean_markdown)
    assert one(spark, once, X.clean_markdown) == once
    assert one(spark, text, X.strip_origin) == text
    marked = one(spark, "x", X.mark_origin)
    assert one(spark, marked, X.strip_origin) == "x"


def test_presentation_forms(spark):
    assert presentation.standard("ﺍﻟﺪﺭﺱ ① ½ ™ ﬁ") == "الدرس ① ½ ™ ﬁ"
    assert one(spark, "ﺍﻟﺪﺭﺱ ①", presentation.to_standard_arabic) == "الدرس ①"


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_script_runs_and_forms(text):
    assert "".join(t for t, _ in presentation.script_runs(text)) == text
    once = presentation.standard(text)
    assert presentation.standard(once) == once


def test_formulas():
    assert presentation.plain_formula(r"\frac{a}{b} \times \sqrt{x} \left( y \right) \| z") == "(a ÷ b) × √(x) ( y ) || z"
    assert presentation.protected_formulas("$x = سرعة$ نص") == "$x = \\text{سرعة}$ نص"


def test_guards(spark):
    df = spark.createDataFrame([("a" * 10_000, "a" * n) for n in (7_400, 7_600, 7_900, 8_100)], "b string, a string")
    got = df.select(F.length(X.guard_client(F.col("b"), F.col("a"))), F.length(X.guard_server(F.col("b"), F.col("a")))).collect()
    assert [r[0] for r in got] == [10_000, 10_000, 10_000, 8_100]
    assert [r[1] for r in got] == [10_000, 7_600, 7_900, 8_100]


def test_chunks_tile_their_range(spark):
    df = spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate([(1, 1), (10, 3), (450, 15), (7, 20)])], "id int, n int, c int")
    rows = batch.plan_chunks(df, F.col("n"), F.col("c")).orderBy("id", "chunk_index").collect()
    for i, n, _ in df.collect():
        own = [r for r in rows if r.id == i]
        assert own[0].start_page == 1 and own[-1].end_page == n and len(own) == own[0].total_chunks
        assert all(a.end_page + 1 == b.start_page for a, b in zip(own, own[1:]))


def test_pages_round_trip(spark):
    df = spark.createDataFrame([(1, "a\n\n---PAGE_BREAK---\n\nb\n\n---PAGE_BREAK---\n\nc")], "doc_id long, text string")
    assert segment.join_pages(segment.pages(df).withColumn("page", F.trim("page"))).first().text.count(X.MARKER) == 2


def test_image_kernels(spark):
    rng = np.random.default_rng(0)
    px = rng.integers(60, 220, (20, 30, 3), dtype=np.uint8)
    out = images.stretched(px)
    assert out.shape == px.shape and out.min() < px.min() and out.max() == 255
    assert (images.stretched(np.full((5, 5, 3), 250, np.uint8)) == 255).all()
    big = rng.integers(0, 256, (401, 401, 3), dtype=np.uint8)
    assert (images.sharpened(px) == px).all() and (images.sharpened(big) != big).any()
    row = spark.createDataFrame([(("a", 20, 30, 3, 16, bytearray(px.tobytes())),), (("b", 9, 9, 3, 16, bytearray(b"xx")),)], "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    got = {r.origin: r for r in images.enhance(row).collect()}
    assert got["a"].aged and bytes(got["b"].data) == b"xx" and got["b"].aged is None


def test_script_run_counts_follow_the_runs(spark):
    from parchwork.plans.more_queries import script_run_counts

    values = ["", "abc", "كلمة", "كلمة abc كلمة", "1 كلمة", "漢 كلمة 漢漢 x كلمة", " . ", "كلمة漢", "a漢b", "漢aكلمة 1"]
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    for r in script_run_counts(df).collect():
        runs = presentation.script_runs(values[r.doc_id])
        assert (r.arabic, r.other) == (sum(a for _, a in runs), sum(not a for _, a in runs)), values[r.doc_id]


def test_script_runs_are_the_text(spark):
    from pyspark.sql import functions as F

    from parchwork.functions import presentation
    from parchwork.plans.fixtures import TEXTS

    rows = [*TEXTS, "12 أب cd é ف.", "é ", "中文 و x", "\U0001f600 ع \U0001f600\U0001f600ع", "ا" * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)] + [(-1, None)], "i int, t string")
    out = {r.i: r.v for r in df.select("i", presentation.script_run_rows(F.col("t")).alias("v")).collect()}
    assert out.pop(-1) is None
    for i, t in enumerate(rows):
        assert [(r.text, r.arabic) for r in out[i]] == presentation.script_runs(t)
