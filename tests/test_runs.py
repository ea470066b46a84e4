"""Runs as streams: order, late rows, restarts."""

import random

from pyspark.sql import functions as F

from tessera.streaming import runs as T

SCHEMA = "event_id bigint, user_id string, ts timestamp, value double"


def test_runs_across_restarts(spark, tmp_path):
    """Three runs of one query: rows in any order, one too late, one without a time; state is settled by timers in between."""

    def write(name, *rows):
        made = spark.createDataFrame(list(rows), "event_id bigint, user_id string, at string, value double")
        made.select("event_id", "user_id", F.to_timestamp("at").alias("ts"), "value").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        T.run_stream(T.fold_stream(rows, "user_id", "ts", "event_id", "value", late="1 day", factor=0.5, patience=2), f"{tmp_path}/out", f"{tmp_path}/state")
        return {r.user_id: (r.n, r.ema, r.seen, r.stopped) for r in T.latest(spark, f"{tmp_path}/out", "user_id").collect()}

    def fold(*values):
        s = T.START
        for v in values:
            s = T.step(s, v, 0.5, 2, 0.001)
        return s[0], s[1], s[4], s[3] >= 2

    write("a", (2, "u", "2024-01-01 12:00:00", 8.0), (1, "u", "2024-01-01 11:00:00", 4.0), (3, "v", "2024-01-01 10:00:00", 1.0), (4, None, "2024-01-01 10:00:00", 2.0), (5, "v", None, 9.0))
    assert run() == {"u": fold(4.0, 8.0), "v": fold(1.0), None: fold(2.0)}
    write("b", (7, "u", "2024-01-01 11:30:00", 2.0), (8, "u", "2024-01-01 11:30:00", 6.0))  # between rows that are there already
    assert run()["u"] == fold(4.0, 2.0, 6.0, 8.0)
    write("c", (9, "u", "2024-01-05 00:00:00", 1.0))
    assert run()["u"] == fold(4.0, 2.0, 6.0, 8.0, 1.0)
    write("d", (10, "u", "2024-01-01 13:00:00", 100.0), (11, "u", "2024-01-05 01:00:00", 3.0))  # the first is older than the watermark
    assert run()["u"] == fold(4.0, 2.0, 6.0, 8.0, 1.0, 3.0)
    assert run()["v"] == fold(1.0)  # nothing new


def folded(rows, factor, patience):
    """By plain Python: (key, n, mean, best, stale, seen) of rows (tie, key, microseconds, value) in order of time and tie breaker."""
    found = {}
    for _, key, _, value in sorted(rows, key=lambda r: (r[2], r[0] is None, r[0] or 0, r[3])):
        found[key] = T.step(found.get(key, T.START), value, factor, patience, 0.001)
    return {(key, *s) for key, s in found.items()}


def test_runs_share_pages(spark, tmp_path):
    """Many runs are few groups; keys are whole numbers beyond doubles, or null; waiting rows are those of one delay, also after a restart."""
    rng, day, rows = random.Random(3), 86_400_000_000, []
    keys = [None, -1, 2**53, 2**53 + 1, *range(56)]
    for batch in range(3):
        new = [(None if i % 17 == 0 else rng.randrange(-(2**60), 2**60), keys[i % 60], 1_700_000_000_000_000 + batch * day + rng.randrange(day), rng.random()) for i in range(240)]
        made = spark.createDataFrame(new, "event_id bigint, user_id bigint, us bigint, value double")
        made.select("event_id", "user_id", F.timestamp_micros("us").alias("ts"), "value").write.parquet(f"{tmp_path}/in/{batch}")
        rows += new
        stream = spark.readStream.schema("event_id bigint, user_id bigint, ts timestamp, value double").parquet(f"{tmp_path}/in/*")
        T.run_stream(T.fold_stream(stream, "user_id", "ts", "event_id", "value", late="1 day", factor=0.5, patience=2, pages=7), f"{tmp_path}/out", f"{tmp_path}/state")
        found = {(r.user_id, r.n, r.ema, r.best, r.stale, r.seen) for r in T.latest(spark, f"{tmp_path}/out", "user_id").collect()}
        assert found == folded(rows, 0.5, 2)
    pages = spark.read.format("statestore").option("stateVarName", "page").load(f"{tmp_path}/state").select("value.*").collect()
    assert 1 < len(pages) <= 7 and sum(len(p.runs) for p in pages) == 60
    # No new row since the third batch, so pages are as it left them: settled up to the watermark that it began with.
    mark = max(r[2] for r in rows[:480]) // 1000 * 1000 - day
    assert sum(len(p.waiting) for p in pages) // T.WAITING.itemsize == sum(r[2] >= mark for r in rows)


def test_streamed_runs_of_odd_events(spark, tmp_path, monkeypatch):
    """A hundred days of events with negative and missing numbers: no set of files goes through one task, and no row is lost."""
    from tessera.plans import documents

    rng = random.Random(5)
    rows = [(None if i == 7 else rng.randrange(-(2**40), 2**40), i % 9, 1_700_000_000_000_000 + rng.randrange(100 * 86_400_000_000), round(rng.random() * 9, 2)) for i in range(400)]
    made = spark.createDataFrame(rows, "event_id bigint, user_id bigint, us bigint, value double").repartition(4)
    made.select("event_id", "user_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "value").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(documents, "scratch", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        found = {tuple(r) for r in documents.streamed_runs(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {(k, n, round(mean, 6), round(best, 6), stale, seen) for k, n, mean, best, stale, seen in folded(rows, 0.98, 5)}
    assert [len(list((tmp_path / "runs" / "in" / half).glob("part-*"))) for half in ("00", "01", "10", "11")] == [4] * 4
