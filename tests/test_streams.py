"""Streams over files, stopped and started again, against the batch queries."""

from pyspark.sql import functions as F

from loomtext.plans import catalog
from loomtext.streaming import events as streams

SF = "/root/testdata/sf0.001"


def landed(spark, tmp_path, parts=6):
    """The events in files by time."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    cuts = [r[0] for r in events.select(F.explode(F.expr(f"approx_percentile(unix_micros(cast(ts as timestamp)), array({', '.join(str(i / parts) for i in range(1, parts))}))"))).collect()]
    for i, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None])):
        at = F.expr("unix_micros(cast(ts as timestamp))")
        some = events.where((at > lo if lo is not None else F.lit(True)) & (at <= hi if hi is not None else F.lit(True)))
        some.coalesce(1).write.parquet(str(tmp_path / f"landing-{i}"))
    target = tmp_path / "in"
    target.mkdir()
    for i in range(parts):
        for f in (tmp_path / f"landing-{i}").glob("*.parquet"):
            f.rename(target / f"{i}.parquet")
            __import__("os").utime(target / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken by time
    return events.schema, str(target)


def test_changes_go_on_after_a_stop(spark, tmp_path):
    schema, source = landed(spark, tmp_path)
    stream = lambda: streams.state_changes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "user_id", ["ts", "event_id"], "event_id", "value")
    asked = []

    def stop():
        asked.append(1)
        return len(asked) > 2

    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    assert not streams.run(stream(), out, mark, stop) and spark.read.parquet(out).select("batch").distinct().count() == 2
    assert not streams.run(stream(), out, mark, lambda: True) and spark.read.parquet(out).select("batch").distinct().count() == 2
    assert streams.run(stream(), out, mark) and streams.run(stream(), out, mark)
    got = sorted(map(tuple, spark.read.parquet(out).select("user_id", "event_id", "change").collect()))
    assert got == sorted(map(tuple, catalog.QUERIES["state_changes"](spark, SF).select("user_id", "event_id", "change").collect()), key=lambda r: r[:2])
    assert spark.read.parquet(out).select("batch").distinct().count() == 6


def test_sessions(spark, tmp_path):
    schema, source = landed(spark, tmp_path, 3)
    timed = lambda df: df.withColumn("at", F.col("ts").cast("timestamp"))
    stream = streams.sessions(timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)), "user_id", "at", "1 hour")
    assert streams.run(stream, str(tmp_path / "out"), str(tmp_path / "mark"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("user_id", "start", "end", "n").collect()}
    whole = timed(spark.read.parquet(f"{SF}/events.parquet"))
    want = {tuple(r) for r in whole.groupBy("user_id", F.session_window("at", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n").collect()}
    last = whole.agg(F.max("at")).first()[0]
    assert got <= want and {r for r in want - got if (last - r[2]).total_seconds() > 7200} == set(), "only sessions that may go on are kept back"
