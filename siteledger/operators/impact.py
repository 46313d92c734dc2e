"""Before/after impact of applied changes, and which kinds of change to trust."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siteledger.functions.scalars import NEGATIVE, outcome
from siteledger.sources.shared import kept

DAYS, GRADUATE_AT = 14, 10
#: Changes of one type and day that stay together, and the parts of a day with more.
SEGMENT_ROWS, PARTS = 1_000_000, 64
LINK_TYPE = "internal-link-suggestion"


def measurable(changes: DataFrame, as_of: dt.date, measured: DataFrame | None = None, exclude_types: list[str] | None = None) -> DataFrame:
    """Merged changes (id, finding_type, status, merged_on, …) that are old enough
    and not measured yet."""
    rows = changes.filter((F.col("status") == "merged") & (F.col("merged_on") <= F.date_sub(F.lit(as_of), DAYS)))
    if exclude_types:
        rows = rows.filter(~F.col("finding_type").isin(exclude_types))
    return rows if measured is None else rows.join(measured.select(F.col("change_id").alias("id")), "id", "left_anti")


def running_clicks(daily: DataFrame) -> DataFrame:
    """day and clicks before the day, for every day from the first to the day
    after the last: a calendar, a row a day."""
    per = daily.groupBy("day").agg(F.sum("clicks").alias("clicks"))
    ends = per.agg(F.min("day").alias("a"), F.date_add(F.max("day"), 1).alias("b"))
    calendar = ends.filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    w = W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    return calendar.join(per, "day", "left").select("day", F.coalesce(F.sum("clicks").over(w), F.lit(0)).alias("before"))


def site_wide_sums(changes: DataFrame, daily: DataFrame, days: int = DAYS) -> DataFrame:
    """changes with clicks before and after: of all pages, days before merged_on
    and from it on. Changes are looked up by day, so each costs three lookups
    in the running sum however long the windows are."""
    run = running_clicks(daily)
    ends = run.agg(F.min("day").alias("__first"), F.max("day").alias("__last"))
    table = F.broadcast(run)  # a row a calendar day
    at = changes.crossJoin(F.broadcast(ends))  # one row
    for name, shift in (("__x", -days), ("__y", 0), ("__z", days)):
        day = F.greatest(F.least(F.date_add("merged_on", shift), F.col("__last")), F.col("__first"))
        found = table.select(F.col("day").alias(f"{name}d"), F.col("before").alias(name))
        at = at.join(found, day == F.col(f"{name}d"), "left").drop(f"{name}d")
    clicks = lambda a, b: F.coalesce(F.col(b) - F.col(a), F.lit(0)).cast("long")
    return at.withColumn("before", clicks("__x", "__y")).withColumn("after", clicks("__y", "__z")).drop("__x", "__y", "__z", "__first", "__last")


def page_sums(changes: DataFrame, daily: DataFrame, days: int = DAYS) -> DataFrame:
    """As site_wide_sums, of the change's own page: each page and day of merging is
    spread over its days and joined on page and day, so the join is an equi-join.

    Spread rows are 2 * days times as many as Spark reckons, so they are merged and
    never broadcast; changes of one page and day share their sums."""
    key = ["page", "merged_on"]
    per = daily.groupBy("page", "day").agg(F.sum("clicks").alias("clicks"))
    spread = changes.select(*key).distinct().select(*key, F.explode(F.sequence(F.date_sub("merged_on", days), F.date_add("merged_on", days - 1))).alias("day"))
    sums = spread.hint("merge").join(per, ["page", "day"]).groupBy(*key).agg(
        F.sum(F.when(F.col("day") < F.col("merged_on"), F.col("clicks")).otherwise(0)).alias("before"),
        F.sum(F.when(F.col("day") >= F.col("merged_on"), F.col("clicks")).otherwise(0)).alias("after"),
    )
    return changes.join(sums, key, "left").select(*changes.columns, "before", "after").fillna(0, ["before", "after"])


def naive_site_wide_sums(changes: DataFrame, daily: DataFrame, days: int = DAYS) -> DataFrame:
    """The same by a range join; the plain form that the running sum replaces."""
    per = daily.groupBy("day").agg(F.sum("clicks").alias("clicks"))
    near = (F.col("day") >= F.date_sub("merged_on", days)) & (F.col("day") < F.date_add("merged_on", days))
    met = changes.join(per, near, "left")
    early = F.col("day") < F.col("merged_on")
    return met.groupBy(*changes.columns).agg(F.coalesce(F.sum(F.when(early, F.col("clicks"))), F.lit(0)).alias("before"), F.coalesce(F.sum(F.when(~early, F.col("clicks"))), F.lit(0)).alias("after"))


def measure(changes: DataFrame, daily: DataFrame, ledger: DataFrame | None = None, base: str | None = None) -> DataFrame:
    """change_id, finding_type, merged_on, before, after, outcome.

    Changes of the link type are measured on the page of the source article,
    which their ledger row names (without one they wait); all others site-wide."""
    with_outcome = lambda df: df.select(F.col("id").alias("change_id"), "finding_type", "merged_on", "before", "after", outcome(F.col("before"), F.col("after")).alias("outcome"))
    if ledger is None:
        return with_outcome(site_wide_sums(changes, daily))
    link = F.col("finding_type") == LINK_TYPE
    source = ledger.select("stable_key", F.get_json_object("detail", "$.sourceSlug").alias("__slug")).filter("__slug is not null")
    paged = changes.filter(link).join(source, "stable_key").withColumn("page", F.concat(F.lit(f"{base or ''}/blog/"), "__slug")).drop("__slug")
    return with_outcome(site_wide_sums(changes.filter(~link), daily)).unionByName(with_outcome(page_sums(paged, daily)))


def _segments(measured: DataFrame, rows: int) -> DataFrame:
    """measured with __part: 0, or of a type's day with more rows than that, the
    range of its change ids that the row is in. A segment is a type, day and part;
    segments follow each other in the order of changes."""
    day = ["finding_type", "merged_on"]
    same = F.col("finding_type").eqNullSafe(F.col("__finding_type")) & F.col("merged_on").eqNullSafe(F.col("__merged_on"))
    apart = {c: f"__{c}" for c in day}
    full = measured.groupBy(*day).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > rows).drop("__n").withColumnsRenamed(apart)
    cuts = F.percentile_approx("change_id", [k / PARTS for k in range(1, PARTS)]).alias("__cuts")
    full = measured.join(full, same, "left_semi").groupBy(*day).agg(cuts).withColumnsRenamed(apart)
    part = F.size(F.filter("__cuts", lambda c: c < F.col("change_id")))
    return measured.join(full, same, "left").withColumn("__part", F.when(F.col("__cuts").isNull(), 0).otherwise(part)).drop("__cuts", *apart.values())


def graduation_steps(measured: DataFrame, records: DataFrame | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """measured with good (streak so far), eligible (from GRADUATE_AT on) and event
    (graduated or revoked) after each change, in the order of merging.

    A negative outcome sets the streak to 0; others add one, inconclusive ones
    included; records give where a type begins. A segmented scan: streaks are
    counted within segments (a type's day, or a part of it), each segment is summed
    up as whether it has a negative and how many are good at its end, these few rows
    carry the streak from segment to segment, and it is added up to the first
    negative. So no task sorts all changes of a type."""
    bad = (F.col("outcome") == NEGATIVE).cast("int")
    key = ["finding_type", "merged_on", "__part"]
    within = W.partitionBy(*key).orderBy("change_id")
    rows = _segments(kept(measured, "measured"), segment_rows).withColumn("__bad", F.coalesce(bad, F.lit(0))).withColumn("__nth", F.row_number().over(within))
    rows = rows.withColumn("__run", F.sum("__bad").over(within.rowsBetween(W.unboundedPreceding, 0)))
    last_bad = F.max(F.when(F.col("__bad") == 1, F.col("__nth"))).over(within.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("__in", F.col("__nth") - F.coalesce(last_bad, F.lit(0)))

    ends = rows.groupBy(*key).agg(F.max("__bad").alias("__has"), F.max_by("__in", "__nth").alias("__tail"))
    along = W.partitionBy("finding_type").orderBy("merged_on", "__part")  # a row a segment
    ends = ends.withColumn("__since", F.sum("__has").over(along.rowsBetween(W.unboundedPreceding, 0)))
    if records is None:
        ends = ends.withColumn("__had", F.lit(0).cast("long")).withColumn("__was", F.lit(False))
    else:
        r = records.select("finding_type", F.col("consecutive_good").alias("__had"), F.col("auto_merge_eligible").alias("__was"))
        ends = ends.join(F.broadcast(r), "finding_type", "left").fillna(0, ["__had"]).fillna(False, ["__was"])  # a row a finding type
    since = W.partitionBy("finding_type", "__since").orderBy("merged_on", "__part").rowsBetween(W.unboundedPreceding, 0)
    ends = ends.withColumn("__end", F.sum("__tail").over(since) + F.when(F.col("__since") == 0, F.col("__had")).otherwise(0))
    ends = ends.withColumn("__first", F.row_number().over(along) == 1).withColumn("__carry", F.coalesce(F.lag("__end").over(along), F.col("__had")))
    ends = ends.select(*[F.col(c).alias(f"__k{n}") for n, c in enumerate(key)], "__first", "__carry", "__was")

    same = F.col("finding_type").eqNullSafe(F.col("__k0")) & F.col("merged_on").eqNullSafe(F.col("__k1")) & (F.col("__part") == F.col("__k2"))
    rows = rows.join(ends, same)
    rows = rows.withColumn("good", F.col("__in") + F.when(F.col("__run") == 0, F.col("__carry")).otherwise(0)).withColumn("eligible", F.col("good") >= GRADUATE_AT)
    # The streak before a change: one less, unless it was broken; then it is that of
    # the row before, counted within the segment or carried into it.
    before_bad = F.lag("__in").over(within) + F.when(F.coalesce(F.lag("__run").over(within), F.lit(0)) == 0, F.col("__carry")).otherwise(0)
    streak = F.when(F.col("__bad") == 0, F.col("good") - 1).otherwise(F.coalesce(before_bad, F.col("__carry")))
    before = F.when(F.col("__first") & (F.col("__nth") == 1), F.col("__was")).otherwise(streak >= GRADUATE_AT)
    event = F.when(F.col("eligible") & ~before, "graduated").when((F.col("__bad") == 1) & before, "revoked")
    return rows.withColumn("event", event).select(*measured.columns, F.col("good").cast("long").alias("good"), "eligible", "event")


def graduation_records(steps: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """finding_type, consecutive_good, auto_merge_eligible after all steps; types
    without a step stay as they were."""
    last = steps.groupBy("finding_type").agg(F.max_by(F.struct("good", "eligible"), F.struct("merged_on", "change_id")).alias("x"))
    new = last.select("finding_type", F.col("x.good").alias("consecutive_good"), F.col("x.eligible").alias("auto_merge_eligible"))
    return new if records is None else records.join(new, "finding_type", "left_anti").unionByName(new)


def impact_actions(steps: DataFrame, changes: DataFrame) -> DataFrame:
    """Alerts and reverts that steps ask for: rows (change_id, finding_type, merged_on, kind).

    kind: revoked, then negative-impact (with a revert row to plan) or
    revert-manual-needed for each negative change; graduated."""
    known = changes.select(F.col("id").alias("change_id"), (F.col("file_path").isNotNull() & F.col("previous_content").isNotNull()).alias("__can"))
    negative = F.col("outcome") == NEGATIVE
    kinds = F.array(F.col("event"), F.when(negative & F.col("__can"), "negative-impact"), F.when(negative & ~F.col("__can"), "revert-manual-needed"))
    return steps.join(known, "change_id").select("change_id", "finding_type", "merged_on", F.explode(F.array_compact(kinds)).alias("kind"))


def alert_texts(actions: DataFrame, changes: DataFrame) -> DataFrame:
    """actions with the subject and body of their alert; changes give pr_url."""
    kind, of = F.col("kind"), F.col("finding_type")
    change = F.concat(F.lit("El cambio "), F.coalesce("pr_url", F.lit("")), F.lit(" (findingType: "), of, F.lit(")"))
    # Subjects and bodies of alerts.
    subject = (
        F.when(kind == "revoked", F.concat(F.lit("Graduación revocada: "), of)).when(kind == "graduated", F.concat(F.lit("Graduación conseguida: "), of))
        .when(kind == "negative-impact", "Impacto negativo detectado — PR de reversión abierto").otherwise("Impacto negativo detectado — reversión manual necesaria")
    )
    body = (
        F.when(kind == "revoked", F.concat(change, F.lit(" mostró un impacto negativo tras el merge. Se revoca autoMergeEligible para este tipo de hallazgo — volverá a necesitar 10 instancias limpias consecutivas.")))
        .when(kind == "graduated", F.concat(of, F.lit(" ha completado 10 instancias consecutivas sin impacto negativo. A partir de ahora, los PRs de este tipo se auto-mergean sin esperar revisión.")))
        .when(kind == "negative-impact", F.concat(change, F.lit(" mostró impacto negativo. Se abrió un PR de reversión. Revísalo y decide si mergearlo — el sistema nunca lo mergea solo.")))
        .otherwise(F.concat(change, F.lit(" mostró impacto negativo, pero no tiene contenido previo capturado (cambio de una fase anterior a Fase 6). Se requiere reversión manual necesaria.")))
    )
    known = changes.select(F.col("id").alias("change_id"), "pr_url")
    return actions.join(known, "change_id").select("change_id", "finding_type", "kind", subject.alias("subject"), body.alias("body"))


def revert_plan(actions: DataFrame, changes: DataFrame) -> DataFrame:
    """A change to open for each negative one whose earlier content is known."""
    due = actions.filter("kind = 'negative-impact'").select(F.col("change_id").alias("id"))
    return changes.join(due, "id", "left_semi").select("stable_key", F.lit("revert").alias("finding_type"), F.lit("open").alias("status"), "file_path", F.col("previous_content").alias("new_content"), F.col("id").alias("reverts_change_id"))
