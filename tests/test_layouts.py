"""Plans over tables laid out for pruning and for joins without a shuffle."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siteledger.operators import findings, ledger, metrics
from siteledger.plans import oracle, queries, records, streams
from siteledger.sinks import ledgers
from siteledger.sources import landing
from siteledger.sources import views as v

NEXT = dt.datetime(2024, 1, 30)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def scan_of(df, column):
    return next(x for x in executed(df).splitlines() if "FileScan" in x and column in x)


def test_static_days_reach_the_scan(spark, small, tmp_path):
    path = str(tmp_path / "snap")
    landing.write_daily(v.view(spark, small, v.SEARCH_SNAPSHOT), path)
    table = spark.read.parquet(path)
    df = metrics.declining_pages(table, v.AS_OF)
    scan = scan_of(df, "clicks")
    assert "PartitionFilters: [isnotnull(date" in scan and "query" not in scan.split("Batched")[0]
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, metrics.declining_pages(v.view(spark, small, v.SEARCH_SNAPSHOT), v.AS_OF).collect()))
    days = {f.split("date=")[1][:10] for f in table.filter("date between '2024-01-05' and '2024-01-07'").select("page").inputFiles()}
    assert days >= {"2024-01-05", "2024-01-06", "2024-01-07"}


def test_days_known_at_run_time_prune_partitions(spark, small):
    df = streams.pruned_decline(spark, small)
    assert "dynamicpruning" in scan_of(df, "clicks") or "dynamicpruning" in executed(df)
    want = {r.page for r in queries.content_declining(spark, small).collect()}
    assert {r.page for r in df.collect()} == want and want


def test_the_ledger_stays_where_it_is(spark, small, tmp_path):
    """Only findings move in the daily merge; the merged table is the next state."""
    snap = v.view(spark, small, v.SEARCH_SNAPSHOT)
    found = findings.scored(findings.current_findings(v.AS_OF, snapshot=snap))
    ledgers.bucketed(ledger.first_ledger(found.filter("finding_type <> 'content-declining'"), dt.datetime(2024, 1, 23)), "ledger_1", str(tmp_path / "l1"))
    plan = executed(ledger.sync_opportunities(spark.table("ledger_1"), found, NEXT))
    lines = plan.splitlines()
    at = next(n for n, x in enumerate(lines) if "FileScan" in x and "ledger_1" in x)
    join = max(n for n in range(at) if "Join" in lines[n] and "FullOuter" in lines[n])
    assert "Bucketed: true" in lines[at]
    assert not any("Exchange" in x or "ShuffleQueryStage" in x for x in lines[join + 1 : at])
    two = ledgers.next_ledger(spark, "ledger_1", "ledger_2", str(tmp_path / "l2"), found, NEXT)
    assert {r.action for r in two.collect()} == {"created", "updated"}
    three = ledgers.next_ledger(spark, "ledger_2", "ledger_3", str(tmp_path / "l3"), found.filter("false"), NEXT)
    assert {(r.status, r.action) for r in three.collect()} == {("resolved", "resolved")}


def test_suggestions_stay_where_they_are(spark, tmp_path):
    rows = [(str(n), "c/a", f"t{n}", 0.5) for n in range(20)]
    pairs = spark.createDataFrame(rows, "stable_key string, source_slug string, target_slug string, similarity double")
    ledgers.bucketed(pairs.filter("stable_key < '15'").withColumn("status", F.lit("open")), "suggestion_1", str(tmp_path / "s1"))
    out = ledgers.next_suggestions(spark, "suggestion_1", "suggestion_2", str(tmp_path / "s2"), pairs.filter("stable_key > '11'"))
    want = {k: ("open", "created") if k >= "15" else ("open", "updated") if k > "11" else ("dismissed", "dismissed") for k, *_ in rows}
    assert {r.stable_key: (r.status, r.action) for r in out.collect()} == want
    lines = executed(ledger.sync_suggestions(spark.table("suggestion_1"), pairs)).splitlines()
    at = next(n for n, x in enumerate(lines) if "FileScan" in x and "suggestion_1" in x)
    join = max(n for n in range(at) if "Join" in lines[n] and "FullOuter" in lines[n])
    assert not any("Exchange" in x or "ShuffleQueryStage" in x for x in lines[join + 1 : at])


def shown(x):
    return repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(streams.QUERIES | records.QUERIES))
def test_stored_and_streamed_queries_equal_their_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "embeddings", "documents", "part", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = (streams.QUERIES | records.QUERIES)[name](spark, small)
    want = con.sql((streams.ORACLE_SQL | records.ORACLE_SQL)[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(shown(r[k]) for k in places) for r in want.fetchall())


def test_every_query_has_sql():
    for module in (streams, records):
        assert set(module.ORACLE_SQL) == set(module.QUERIES) and not set(module.QUERIES) & set(oracle.ORACLE_SQL)


def test_corrections_are_derived_from_events_once(spark, small, monkeypatch):
    """weeks land from stored arrivals, not from all events again each."""
    read = []

    def landed(rows, folder):
        read.extend(rows.inputFiles())
        return []

    monkeypatch.setattr(streams, "landed", landed)
    monkeypatch.setattr(streams.SnapshotTable, "read", lambda self: None)
    streams.streamed_corrections(spark, small)
    assert read and all("/arrivals-" in f for f in read)
