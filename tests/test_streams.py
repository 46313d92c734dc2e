import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siteledger import streaming
from siteledger.sinks import newest_version, upsert_versions
from siteledger.sinks.snapshots import SnapshotTable

SCHEMA = "date date, page string, query string, clicks int"
ROWS = SCHEMA + ", arrived timestamp, place int"
KEYS = ["date", "page", "query"]
DAY = dt.date(2026, 7, 1)


def at(days, hours=12):
    return dt.datetime(2026, 7, 1) + dt.timedelta(days, hours=hours)


def arrivals(spark, rows):
    """(day, query, clicks, arrived on day) as rows, placed in their order."""
    return spark.createDataFrame([(DAY + dt.timedelta(d), "p", q, c, at(a), n) for n, (d, q, c, a) in enumerate(rows)], ROWS)


def corrected(spark, tmp_path, batches):
    session, land, out = streaming.streaming_session(spark), str(tmp_path / "land"), str(tmp_path / "out")
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(land)
        stream = session.readStream.schema(ROWS).parquet(land)
        streaming.final_rows(streaming.last_arrivals(stream, KEYS, ["arrived", "place"]), out, SCHEMA, KEYS, str(tmp_path / "cp")).awaitTermination()
    return sorted(((r.date - DAY).days, r.query, r.clicks) for r in SnapshotTable(spark, out, SCHEMA).read().collect())


def test_corrections_count_for_three_days(spark, tmp_path):
    """The last in time wins, lower or not; the query stops and goes on from its checkpoint."""
    rows = [(0, "a", 5, 0), (0, "b", 1, 0), (0, "a", 4, 3), (0, "b", 9, 4), (1, "a", 7, 2), (9, "z", 1, 9)]
    got = corrected(spark, tmp_path, [arrivals(spark, rows[:2]), arrivals(spark, rows[2:4]), arrivals(spark, rows[4:])])
    # Day 9 is not final: its corrections may still come.
    assert got == [(0, "a", 4), (0, "b", 1), (1, "a", 7)]


def test_batching_makes_no_difference(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted(((d, q, rng.randint(0, 99), d + rng.randint(0, 6)) for d in range(8) for q in "abc" for _ in range(3)), key=lambda r: r[3])
    want = {}
    for d, q, c, a in rows:
        if a <= d + 3 and d + 4 <= 7:
            want[d, q] = c
    whole = arrivals(spark, rows)
    cut = [whole.filter(f"place >= {a} AND place < {b}") for a, b in ((0, 20), (20, 45), (45, len(rows)))]
    assert corrected(spark, tmp_path, cut) == sorted((d, q, c) for (d, q), c in want.items())


def test_late_rows_are_told_apart(spark, tmp_path):
    rows = [(at(0, 3), "p", 2, at(0, 3)), (at(0, 9), "p", 3, at(2)), (at(0, 9), "p", 50, at(6)), (at(7), "p", 4, at(7))]
    land, totals, late = (str(tmp_path / n) for n in ("land", "totals", "late"))
    schema = "ts timestamp, page string, clicks long, arrived timestamp"
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(land)
        stream = streaming.streaming_session(spark).readStream.schema(schema).parquet(land)
        streaming.append_stream(streaming.daily_totals(stream), totals, str(tmp_path / "c1")).awaitTermination()
        streaming.append_stream(streaming.too_late(stream), late, str(tmp_path / "c2")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(totals).collect()] == [(DAY, "p", 2, 3)]
    assert [r.clicks for r in spark.read.parquet(late).collect()] == [50]


def test_health_goes_on_over_batches(spark, tmp_path):
    """A newer run starts from 0, an older one's steps are left out, and a batch that
    is run again changes nothing."""
    schema = "workflow string, run_on date, step_no long, outcome string"
    day = lambda n: DAY + dt.timedelta(n)
    parts = [[("a", day(0), 1, "failure"), ("b", day(0), 2, "failure")], [("a", day(1), 3, "success"), ("a", day(0), 4, "failure"), ("b", day(0), 5, "failure"), ("c", None, 6, "failure")], [("a", day(1), 7, "failure")]]
    land, folder = str(tmp_path / "land"), str(tmp_path / "health")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(land)
        stream = streaming.streaming_session(spark).readStream.schema(schema).parquet(land)
        streaming.run_to_end(streaming.newest_runs(stream, 4), upsert_versions(folder, ["workflow", "part"]), str(tmp_path / "cp"), "update")
    last = newest_version(spark, folder)
    upsert_versions(folder, ["workflow", "part"])(spark.createDataFrame(last.collect(), last.schema), 2)
    got = {r.workflow: (r.run_on, r.status, r.failed_steps) for r in streaming.workflow_status(newest_version(spark, folder)).collect()}
    assert got == {"a": (day(1), "failed", 1), "b": (day(0), "failed", 2)}


# --- snapshot tables -------------------------------------------------------


def snap(spark, *rows):
    return spark.createDataFrame([(None if d is None else dt.date(2026, 7, d), "p", q, c) for d, q, c in rows], SCHEMA)


def content(table, **what):
    return sorted((r.date.day if r.date else 0, r.query, r.clicks) for r in table.read(**what).collect())


def test_upserts_make_versions(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), SCHEMA)
    assert content(t) == [] and t.upsert(snap(spark), KEYS) == 0
    assert t.upsert(snap(spark, (1, "a", 5), (2, "a", 5), (None, "n", 1)), KEYS) == 1
    assert t.upsert(snap(spark, (2, "a", 3), (2, "b", 1), (None, "n", 2)), KEYS) == 2
    assert content(t) == [(0, "n", 2), (1, "a", 5), (2, "a", 3), (2, "b", 1)]
    assert content(t, version=1) == [(0, "n", 1), (1, "a", 5), (2, "a", 5)]
    assert content(t, first="2026-07-02", last="2026-07-02") == [(2, "a", 3), (2, "b", 1)]
    files = t.read(first="2026-07-02").inputFiles()
    assert files and all("date=2026-07-02" in f for f in files)


def test_the_last_arrival_of_a_batch_wins(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), SCHEMA)
    rows = snap(spark, (2, "a", 9), (2, "a", 4)).withColumn("place", F.when(F.col("clicks") == 4, 2).otherwise(1))
    t.upsert(rows, KEYS, ["place"])
    assert content(t) == [(2, "a", 4)]


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_a_writer_that_is_lost_changes_nothing(spark, tmp_path, monkeypatch, scheme):
    t = SnapshotTable(spark, f"{scheme}{tmp_path}/t", SCHEMA)
    t.upsert(snap(spark, (1, "a", 5)), KEYS)

    def lost(self, version, days):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "publish", lost)
        with pytest.raises(KeyboardInterrupt):
            t.upsert(snap(spark, (1, "a", 9), (2, "b", 1)), KEYS)
    assert content(t) == [(1, "a", 5)]
    t.upsert(snap(spark, (1, "b", 2)), KEYS)
    assert content(t) == [(1, "a", 5), (1, "b", 2)]
    assert t.vacuum() == 0  # what the lost writer left is young: it might still be at work
    assert t.vacuum(young_seconds=-60) == 1 and content(t) == [(1, "a", 5), (1, "b", 2)]
    assert t.vacuum(keep=1, young_seconds=-60) == 2 and content(t) == [(1, "a", 5), (1, "b", 2)]


def test_two_writers_lose_no_row(spark, tmp_path, monkeypatch):
    """Another writer publishes between the first one's read and its rename."""
    path = str(tmp_path / "t")
    t = SnapshotTable(spark, path, SCHEMA)
    t.upsert(snap(spark, (1, "a", 5)), KEYS)
    publish, tried = SnapshotTable.publish, []

    def late(self, version, days):
        if not tried:
            tried.append(version)
            SnapshotTable(spark, path, SCHEMA).upsert(snap(spark, (1, "other", 7)), KEYS)
        return publish(self, version, days)

    monkeypatch.setattr(SnapshotTable, "publish", late)
    assert t.upsert(snap(spark, (1, "mine", 6)), KEYS) == 3
    assert content(t) == [(1, "a", 5), (1, "mine", 6), (1, "other", 7)]
