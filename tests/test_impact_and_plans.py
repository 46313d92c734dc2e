import datetime as dt

from siteledger.operators import changes, impact, reporting
from siteledger.plans import queries
from siteledger.sources import views
from siteledger.sources.views import view

T = dt.date(2026, 7, 15)


def test_running_sum_equals_range_join(spark, small):
    due = impact.measurable(view(spark, small, views.APPLIED_CHANGE), queries.CHANGES_AS_OF).select("id", "merged_on")
    daily = view(spark, small, views.DAILY_CLICKS)
    get = lambda df: sorted(map(tuple, df.select("id", "before", "after").collect()))
    assert get(impact.site_wide_sums(due, daily)) == get(impact.naive_site_wide_sums(due, daily))


def test_windows_and_pages(spark):
    d = lambda n: T + dt.timedelta(n)
    daily = spark.createDataFrame([(d(-15), "p", 1), (d(-14), "p", 10), (d(-1), "q", 20), (d(0), "p", 5), (d(13), "q", 6), (d(14), "p", 100)], "day date, page string, clicks long")
    c = spark.createDataFrame([(1, "p", T), (2, "q", d(400)), (3, "p", d(-400))], "id long, page string, merged_on date")
    get = lambda df: {r.id: (r.before, r.after) for r in df.collect()}
    assert get(impact.site_wide_sums(c, daily)) == {1: (30, 11), 2: (0, 0), 3: (0, 0)}
    assert get(impact.page_sums(c, daily)) == {1: (10, 5), 2: (0, 0), 3: (0, 0)}
    assert get(impact.site_wide_sums(c, daily.filter("false"))) == {1: (0, 0), 2: (0, 0), 3: (0, 0)}


def test_page_sums_broadcast_no_spread_days(spark, small):
    """changes look small to the planner, spread over 28 days they are not."""
    due = impact.measurable(view(spark, small, views.APPLIED_CHANGE), queries.CHANGES_AS_OF)
    sums = impact.page_sums(due, view(spark, small, views.DAILY_CLICKS))
    plan = sums._jdf.queryExecution().sparkPlan().toString()
    above = plan[: plan.index("Generate explode")].splitlines()
    assert "SortMergeJoin [page" in plan and not any("BroadcastHashJoin" in line and "day" in line for line in above)


def test_page_sums_of_changes_alike(spark):
    daily = spark.createDataFrame([(T, "p", 5), (T - dt.timedelta(1), "p", 3)], "day date, page string, clicks long")
    c = spark.createDataFrame([(1, "p", T), (2, "p", T), (2, "p", T), (3, None, T), (4, "p", None)], "id long, page string, merged_on date")
    got = impact.page_sums(c, daily)
    assert got.columns == ["id", "page", "merged_on", "before", "after"]
    assert sorted((r.id, r.before, r.after) for r in got.collect()) == [(1, 3, 5), (2, 3, 5), (2, 3, 5), (3, 0, 0), (4, 0, 0)]


def test_measurable(spark):
    c = spark.createDataFrame([(1, "t", "merged", T - dt.timedelta(15)), (2, "t", "merged", T - dt.timedelta(5)), (3, "t", "open", T - dt.timedelta(15)), (4, "t", "merged", T - dt.timedelta(15)), (5, "revert", "merged", T - dt.timedelta(15))], "id long, finding_type string, status string, merged_on date")
    done = spark.createDataFrame([(4,)], "change_id long")
    assert {r.id for r in impact.measurable(c, T, done).collect()} == {1, 5}
    assert {r.id for r in impact.measurable(c, T, done, ["revert"]).collect()} == {1}


def measured(spark, outcomes, kind="t"):
    return spark.createDataFrame([(n, kind, T + dt.timedelta(n), o) for n, o in enumerate(outcomes)], "change_id long, finding_type string, merged_on date, outcome string")


def test_streaks(spark):
    steps = impact.graduation_steps(measured(spark, ["positive"] * 9 + ["inconclusive", "negative", "positive"]))
    got = [(r.good, r.eligible, r.event) for r in steps.orderBy("change_id").collect()]
    assert got[8:] == [(9, False, None), (10, True, "graduated"), (0, False, "revoked"), (1, False, None)]
    assert impact.graduation_records(steps).first()[1:] == (1, False)


def test_streaks_go_on_from_records(spark):
    records = spark.createDataFrame([("t", 9, False), ("u", 12, True), ("w", 3, False)], "finding_type string, consecutive_good long, auto_merge_eligible boolean")
    rows = measured(spark, ["positive"]).unionByName(measured(spark, ["negative"], "u"))
    steps = impact.graduation_steps(rows, records)
    assert {r.finding_type: (r.good, r.event) for r in steps.collect()} == {"t": (10, "graduated"), "u": (0, "revoked")}
    assert {tuple(r) for r in impact.graduation_records(steps, records).collect()} == {("t", 10, True), ("u", 0, False), ("w", 3, False)}


def test_alerts_and_reverts(spark):
    records = spark.createDataFrame([("t", 12, True)], "finding_type string, consecutive_good long, auto_merge_eligible boolean")
    steps = impact.graduation_steps(measured(spark, ["negative", "negative"]), records)
    c = spark.createDataFrame([(0, "k0", "f", "old", "merged"), (1, "k1", "f", None, "merged")], "id long, stable_key string, file_path string, previous_content string, status string")
    actions = impact.impact_actions(steps, c)
    assert sorted((r.change_id, r.kind) for r in actions.collect()) == [(0, "negative-impact"), (0, "revoked"), (1, "revert-manual-needed")]
    assert [(r.reverts_change_id, r.new_content) for r in impact.revert_plan(actions, c).collect()] == [(0, "old")]


def test_link_changes_are_measured_on_their_page(spark):
    daily = spark.createDataFrame([(T - dt.timedelta(1), "b/blog/s", 10), (T, "b/blog/s", 20), (T - dt.timedelta(1), "x", 1000)], "day date, page string, clicks long")
    c = spark.createDataFrame([(1, "internal-link-suggestion", "k", T), (2, "internal-link-suggestion", "none", T), (3, "other", "o", T)], "id long, finding_type string, stable_key string, merged_on date")
    ledger = spark.createDataFrame([("k", '{"sourceSlug":"s"}'), ("none", "{}")], "stable_key string, detail string")
    got = {r.change_id: (r.before, r.after, r.outcome) for r in impact.measure(c, daily, ledger, "b").collect()}
    assert got == {1: (10, 20, "positive"), 3: (1010, 20, "negative")}


def plan(spark, ledger, open_changes=(), ready=(), cap=3):
    l = spark.createDataFrame(ledger, "stable_key string, finding_type string, priority_score double, status string")
    c = spark.createDataFrame(list(open_changes), "stable_key string, finding_type string, status string")
    g = spark.createDataFrame([(t, 10, True) for t in ready], "finding_type string, consecutive_good long, auto_merge_eligible boolean")
    return {r.stable_key: (r.action, r.auto_merge) for r in changes.tier1_plan(l, c, g, cap).collect()}


BLOCKS, MISSING = "robots-blocks-all", "robots-missing-sitemap-directive"


def test_plan(spark):
    rows = [("a", BLOCKS, 10.0, "open"), ("b", MISSING, 4.0, "open"), ("c", "content-declining", 1.0, "open"), ("d", BLOCKS, 10.0, "resolved")]
    assert plan(spark, rows) == {"a": ("open", False), "b": ("skippedDuplicate", False)}
    assert plan(spark, rows, ready=[BLOCKS])["a"] == ("open", True)
    assert plan(spark, rows, [("a", BLOCKS, "open")]) == {"a": ("skippedDuplicate", False), "b": ("skippedDuplicate", False)}
    assert plan(spark, rows, [("z", MISSING, "open")]) == {"a": ("skippedDuplicate", False), "b": ("open", False)}
    assert plan(spark, rows, [("a", BLOCKS, "merged")])["a"] == ("open", False)


def test_plan_stops_at_the_cap(spark):
    rows = [(k, BLOCKS, 10.0, "open") for k in "abcde"]
    assert plan(spark, rows) == {k: ("open", False) for k in "abc"}


def test_change_status(spark):
    c = spark.createDataFrame([(1, "open"), (2, "open"), (3, "open"), (4, "merged"), (5, "open")], "pr_number long, status string")
    s = spark.createDataFrame([(1, "open", False), (2, "closed", True), (3, "closed", False), (4, "open", False)], "pr_number long, state string, merged boolean")
    assert {r.pr_number: r.status for r in changes.sync_changes(c, s).collect()} == {1: "open", 2: "merged", 3: "closed", 4: "merged", 5: "open"}


def test_briefing(spark):
    detail = '{"sourceSlug":"s","targetSlug":"t","similarity":0.5}'
    rows = [("a", "internal-link-suggestion", "A", 2.0, detail, "open", None), ("b", "internal-link-suggestion", "B", 2.0, detail, "open", "h"), ("c", "internal-link-suggestion", "C", 2.0, detail, "open", "older"), ("d", "internal-link-suggestion", "D", 2.0, None, "open", "h"), ("e", "sitemap-out-of-domain", "E", 3.0, "x", "open", "h"), ("f", "content-declining", "F", 1.0, "x", "open", None)]
    l = spark.createDataFrame([(*r, "ref") for r in rows], "stable_key string, finding_type string, title string, priority_score double, detail string, status string, reviewed_content_hash string, source_ref_id string")
    a = spark.createDataFrame([("s", "h", "x" * 3000), ("t", "g", "target")], "slug string, content_hash string, text string")
    got = reporting.briefing_rows(l, a)
    assert [(r.stable_key, r.malformed) for r in got.collect()] == [("e", False), ("a", False), ("c", False), ("d", True)]
    assert {len(r.source_text) for r in got.collect() if r.source_text} == {2000}
    text = reporting.briefing_text(got).first().value
    assert text.startswith("# Briefing Tier 2\n\n4 oportunidades") and "Datos malformados" in text and text.index("## E") < text.index("## A")
    assert "No hay oportunidades" in reporting.briefing_text(got.filter("false")).first().value


def test_health_and_expiry(spark):
    steps = spark.createDataFrame([("a", "success"), ("a", "skipped"), ("b", "success"), ("b", "failure")], "workflow string, outcome string")
    health = reporting.workflow_health(steps)
    assert {r.workflow: (r.status, r.failed_steps) for r in health.collect()} == {"a": ("ok", 0), "b": ("failed", 1)}
    now = dt.datetime(2026, 7, 1, 12)
    assert [(r.type, r.acknowledged) for r in reporting.workflow_alerts(health, now).collect()] == [("workflow-failed", False)]
    e = spark.createDataFrame([("soon", "2026-07-11 00:00:00"), ("far", "2027-01-01"), ("bad", "never"), ("none", None)], "name string, expires_at string")
    assert [(r.name, r.days_left) for r in reporting.expiry_alerts(e, now).collect()] == [("soon", 10)]


def folded(rows, had=0, was=False):
    """Streaks one change after the other."""
    out = {}
    for _, i, o in sorted(rows):
        good = 0 if o == "negative" else had + 1
        eligible = good >= 10
        out[i] = (good, eligible, "graduated" if eligible and not was else "revoked" if o == "negative" and was else None)
        had, was = good, eligible
    return out


def test_streaks_of_segments_equal_a_fold(spark):
    """Days cut into parts, days without a negative, and types that begin in the middle."""
    import random

    rng = random.Random(8)
    rows, want = [], {}
    starts = {"t0": (0, False), "t1": (9, False), "t2": (12, True), "t3": (3, True)}
    for kind, start in starts.items():
        own = [(T + dt.timedelta(rng.choice([0, 0, 0, 1, 2, 5, 9])), 1000 * int(kind[1]) + n, rng.choices(["positive", "negative", "inconclusive"], [80, 4, 10])[0]) for n in range(150)]
        rows += [(i, kind, d, o) for d, i, o in own]
        want |= folded(own, *start)
    measured_ = spark.createDataFrame(rows, "change_id long, finding_type string, merged_on date, outcome string")
    records = spark.createDataFrame([(k, *x) for k, x in starts.items()], "finding_type string, consecutive_good long, auto_merge_eligible boolean")
    for size in (5, 40, 10**6):
        got = {r.change_id: (r.good, r.eligible, r.event) for r in impact.graduation_steps(measured_, records, size).collect()}
        assert got == want
    events = {e for _, _, e in want.values()}
    assert events == {None, "graduated", "revoked"}


def test_no_window_holds_all_changes_of_a_type(spark, small):
    import re

    due = impact.measurable(view(spark, small, views.APPLIED_CHANGE), queries.CHANGES_AS_OF)
    plan = impact.graduation_steps(impact.measure(due, view(spark, small, views.DAILY_CLICKS)))._jdf.queryExecution().optimizedPlan().toString()
    specs = re.findall(r"^[ :+-]*Window \[.*\], \[(.*?)\], \[.*\]$", plan, re.M)
    # Segments' own summaries are windowed by type, rows only within a segment.
    assert any("__part" in s for s in specs)
    assert all("__part" in s for s in specs if "change_id" in s)
