"""A stream of chunks that stops and goes on, against the batch query."""

from datetime import datetime, timedelta

from parchwork.streaming import settle

T0 = datetime(2026, 1, 1)


def chunk(doc, index, n, pages, minute, failed=False):
    return (doc, index, n, pages, failed, T0 + timedelta(minutes=minute))


FILES = [
    # 1: in disorder and twice, over a stop; 2: its second chunk fails; 3: never finished; 4: empty pages
    [chunk(1, 1, 3, ["b", "c"], 0), chunk(2, 0, 3, ["x"], 0), chunk(3, 0, 3, ["p", "q"], 0), chunk(4, 0, 2, [], 1), (None, 0, 1, ["?"], False, T0)],
    [chunk(1, 0, 3, ["a"], 2), chunk(1, 1, 3, ["other"], 2), chunk(2, 2, 3, ["z"], 2), chunk(3, 2, 3, ["s"], 2)],
    [chunk(1, 2, 3, ["d"], 3), chunk(2, 1, 3, None, 3, True), chunk(4, 1, 2, ["only"], 3), chunk(2, 1, 3, ["late"], 4)],
    [chunk(9, 0, 1, ["later"], 60)],
    [chunk(9, 0, 1, ["again"], 61), chunk(10, 0, 1, ["last"], 120)],
]
EVERY = [(1, k, p, False) for k, p in enumerate("abcd", 1)] + [(2, 1, "x", False), (2, 2, None, True), (3, 1, "p", False), (3, 2, "q", False), (3, 3, None, True), (4, 1, "only", False), (9, 1, "later", False), (10, 1, "last", False)]


def test_stream_goes_on_in_the_middle_of_a_document(spark, tmp_path):
    source, target, place = (str(tmp_path / n) for n in ("in", "out", "place"))

    def run():
        stream = spark.readStream.schema(settle.CHUNK).option("maxFilesPerTrigger", 1).parquet(source)
        query = settle.settled_stream(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", place).trigger(availableNow=True).start()
        query.awaitTermination()

    seen = []
    for rows in FILES:  # the query stops behind each file
        spark.createDataFrame(rows, settle.CHUNK).coalesce(1).write.mode("append").parquet(source)
        run()
        seen.append(sorted(map(tuple, spark.read.schema(settle.SETTLED).parquet(target).collect()), key=str))
    assert (1, 1, "a", False) not in seen[0] and (1, 3, "c", False) in seen[1] and (1, 4, "d", False) in seen[2]
    assert (3, 3, None, True) not in seen[2]
    assert seen[-1] == sorted(EVERY, key=str)
    assert sorted(map(tuple, settle.settled(spark.createDataFrame([r for f in FILES for r in f], settle.CHUNK)).collect()), key=str) == seen[-1]


def test_rescued_documents_are_whole(spark):
    rows = spark.createDataFrame([(2, 1, "x", False), (2, 2, None, True), (5, 1, "y", False)], settle.SETTLED)
    direct = spark.createDataFrame([(2, k, f"direct {k}") for k in (1, 2, 3)] + [(5, 1, "unused")], "doc_id long, page_no long, page string")
    assert sorted(map(tuple, settle.whole_pages(rows, direct).collect())) == [(2, 1, "x"), (2, 2, "direct 2"), (2, 3, "direct 3"), (5, 1, "y")]
    assert settle.settled(spark.createDataFrame([], settle.CHUNK)).count() == 0
