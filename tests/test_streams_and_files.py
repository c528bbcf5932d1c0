import datetime as dt

from pyspark.sql import functions as F

from weftline.sources import readers, writers
from weftline.streaming import incremental as s


def test_block_stream_equals_batch(spark, tmp_path):
    schema = "k string, ts timestamp, v double"
    for n in range(3):
        spark.createDataFrame([(f"k{i % 2}", dt.datetime(2024, 1, 1) + dt.timedelta(days=3 * (10 * n + i)), float(i)) for i in range(10)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = s.block_counts(s.new_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1), "ts", "k", 2, "1 day", "v")
    stream.writeStream.format("memory").queryName("blocks_test").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    batch = s.block_counts(spark.read.parquet(str(tmp_path / "in")), "ts", "k", 2, value="v")
    assert sorted(map(tuple, spark.table("blocks_test").collect())) == sorted(map(tuple, batch.collect()))


def test_resume_skips_done_keys(spark, tmp_path):
    source, target, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    work = lambda df: df.select("k", F.lit("ok").alias("state"))
    for batch in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([(k,) for k in batch], "k long").coalesce(1).write.mode("append").parquet(source)
        stream = s.new_files(spark, source, spark.read.parquet(source).schema)
        s.resume_into(stream, work, ["k"], target, mark).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_latest_table(spark, tmp_path):
    source, target, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    for rows in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")]):
        spark.createDataFrame(rows, "k long, at int, v string").coalesce(1).write.mode("append").parquet(source)
        s.keep_latest(s.new_files(spark, source, spark.read.parquet(source).schema), ["k"], "at", target, mark).awaitTermination()
    version = s.current_version(spark, target)
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{target}/version={version}").collect()) == [(1, "c"), (2, "b")]


def test_interval_join_in_streams(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    e, m = str(tmp_path / "e"), str(tmp_path / "m")
    spark.createDataFrame([(1, at)], "k long, seen timestamp").write.parquet(e)
    spark.createDataFrame([(1, at + dt.timedelta(hours=h)) for h in (-1, 0, 24, 25)], "k long, told timestamp").write.parquet(m)
    read = lambda p: s.new_files(spark, p, spark.read.parquet(p).schema)
    joined = s.mentions_in_time(read(e), read(m), "k", "seen", "told")
    joined.writeStream.format("memory").queryName("joined_test").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("joined_test").count() == 2 == s.mentions_in_time(spark.read.parquet(e), spark.read.parquet(m), "k", "seen", "told").count()


def test_readers_and_writers(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('k,v\n1,"two\nlines, é"\n2,"say ""hi"""\n'.encode("latin-1"))
    df = readers.csv(spark, str(path), "k long, v string", "ISO-8859-1")
    assert [r.v for r in df.orderBy("k").collect()] == ["two\nlines, é", 'say "hi"'] and readers.header(spark, str(path)) == ["k", "v"]
    (tmp_path / "l.json").write_text('{"k": 1}\n\n{"k": 2, "error": "x"}\nnot json\n')
    assert [r.k for r in readers.json_lines(spark, str(tmp_path / "l.json"), "k long, error string").collect()] == [1]
    assert readers.optional(spark, str(tmp_path / "none"), "k long").count() == 0
    writers.twins(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t.parquet")).count() == 2 and readers.fresher_twin(str(tmp_path / "t.csv"))[0] in ("parquet", "csv")
    assert writers.watermark(spark, str(tmp_path / "w")) is None
    writers.watermark(spark, str(tmp_path / "w"), "20240101")
    assert writers.watermark(spark, str(tmp_path / "w")) == "20240101"
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return "done"

    assert readers.with_retries(flaky, 5, 0.0, sleep=lambda s: None) == "done" and len(calls) == 3
    pages = readers.fetched(spark.createDataFrame([(1, "u"), (2, "bad")], "k long, url string"), lambda u: (200, "text/html", "<p>x</p>") if u == "u" else (404, "text/html", ""), "k", "url")
    assert {r.k: r.failure for r in pages.collect()} == {1: None, 2: "http_error"}
