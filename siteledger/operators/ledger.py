"""The deduplicated ledger of findings, and keyed merges in general."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions.rules import ALL_SOURCES

CREATED, REOPENED, UPDATED, RESOLVED, KEPT = "created", "reopened", "updated", "resolved", "kept"
DISMISSED = "dismissed"


def upsert(old: DataFrame, new: DataFrame, keys: list[str], arrival: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """old with new's rows in place of those with the same keys.

    Of new rows with one key the last arrival wins. Columns in keep stay as they
    were where a row was there before."""
    if arrival is not None:
        rest = [c for c in new.columns if c not in keys]
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), arrival).alias("__x")).select(*keys, "__x.*").select(*new.columns)
    if not keep:
        return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
    was = old.withColumnsRenamed({c: f"__old_{c}" for c in old.columns if c not in keys}).withColumn("__was", F.lit(True))
    now = new.withColumn("__now", F.lit(True))
    both = now.join(was, keys, "full_outer")
    pick = lambda c: F.when(F.col("__was") & (F.col("__now").isNull() | F.lit(c in keep)), F.col(f"__old_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*keys, *[pick(c) for c in new.columns if c not in keys])


def sync_opportunities(ledger: DataFrame, found: DataFrame, now: dt.datetime, scope: list[str] | None = None) -> DataFrame:
    """The next ledger, with the action taken on each row.

    found: `findings.scored` rows, one a key. A key that is new is created; a
    resolved one that is found again is reopened; an open one is updated; an
    open one that is not found any more is resolved, if its source is in scope.
    Found rows rewrite what they show (reference, title, detail, priority) and
    nothing else."""
    was = ledger.alias("l")
    is_ = found.alias("f")
    both = was.join(is_, F.col("l.stable_key") == F.col("f.stable_key"), "full_outer")
    old, new = F.col("l.stable_key").isNotNull(), F.col("f.stable_key").isNotNull()
    open_ = F.col("l.status") == "open"
    in_scope = F.col("l.source").isin(scope or ALL_SOURCES)
    action = F.when(~old, CREATED).when(new & open_, UPDATED).when(new, REOPENED).when(open_ & in_scope, RESOLVED).otherwise(KEPT)
    seen = lambda c: F.when(new, F.col(f"f.{c}")).otherwise(F.col(f"l.{c}")).alias(c)
    first = lambda c: F.when(old, F.col(f"l.{c}")).otherwise(F.col(f"f.{c}")).alias(c)
    at = F.lit(now).cast("timestamp")
    return both.select(
        F.coalesce("l.stable_key", "f.stable_key").alias("stable_key"), first("source"), seen("source_ref_id"), first("finding_type"), seen("title"), seen("detail"),
        first("impact"), first("effort"), seen("priority_score"),
        F.when(new, "open").when(open_ & in_scope, "resolved").otherwise(F.col("l.status")).alias("status"),
        F.coalesce("l.first_detected_at", at).alias("first_detected_at"),
        F.when(new, F.lit(None).cast("timestamp")).when(open_ & in_scope, at).otherwise(F.col("l.resolved_at")).alias("resolved_at"),
        *[F.col(f"l.{c}").alias(c) for c in ("reviewed_at", "reviewed_content_hash", "review_reason")],
        action.alias("action"),
    )


def first_ledger(found: DataFrame, now: dt.datetime) -> DataFrame:
    empty = found.sparkSession.createDataFrame([], _opportunity())
    return sync_opportunities(empty, found, now).drop("action")


def _opportunity() -> str:
    from siteledger.schemas import OPPORTUNITY

    return OPPORTUNITY


def action_counts(merged: DataFrame, actions: tuple[str, ...] = (CREATED, REOPENED, UPDATED, RESOLVED)) -> DataFrame:
    """One row of counters."""
    return merged.agg(*[F.count_if(F.col("action") == a).alias(a) for a in actions])


def sync_suggestions(old: DataFrame, pairs: DataFrame) -> DataFrame:
    """Link suggestions after a run, with the action: pairs that are new are
    created open, known ones refreshed in whatever state they are, open ones
    that are no longer suggested are dismissed."""
    l, p = old.alias("l"), pairs.alias("p")
    both = l.join(p, F.col("l.stable_key") == F.col("p.stable_key"), "full_outer")
    was, is_, open_ = F.col("l.stable_key").isNotNull(), F.col("p.stable_key").isNotNull(), F.col("l.status") == "open"
    action = F.when(~was, CREATED).when(is_, UPDATED).when(open_, DISMISSED).otherwise(KEPT)
    return both.select(
        *[F.coalesce(f"l.{c}", f"p.{c}").alias(c) for c in ("stable_key", "source_slug", "target_slug")],
        F.coalesce("p.similarity", "l.similarity").alias("similarity"),
        F.when(~was, "open").when(~is_ & open_, DISMISSED).otherwise(F.col("l.status")).alias("status"), action.alias("action"),
    )


def record_reviews(ledger: DataFrame, reviews: DataFrame, articles: DataFrame, now: dt.datetime) -> DataFrame:
    """ledger with verdicts of reviews (stable_key, verdict, reason): a rejected
    row keeps its state and remembers when, why and which text was judged; an
    applied one is resolved."""
    v = reviews.select("stable_key", "verdict", "reason").dropDuplicates(["stable_key"])
    hashes = articles.select(F.col("slug").alias("__slug"), F.col("content_hash").alias("__hash"))
    rows = ledger.join(v, "stable_key", "left").withColumn("__source", F.get_json_object("detail", "$.sourceSlug"))
    rows = rows.join(hashes, F.col("__source") == F.col("__slug"), "left")
    rejected, applied = F.col("verdict") == "rejected", F.col("verdict") == "applied"
    at = F.lit(now).cast("timestamp")
    pick = lambda test, value, c: F.when(test, value).otherwise(F.col(c)).alias(c)
    new = {
        "status": pick(applied, F.lit("resolved"), "status"), "resolved_at": pick(applied, at, "resolved_at"), "reviewed_at": pick(rejected, at, "reviewed_at"),
        "reviewed_content_hash": pick(rejected, F.col("__hash"), "reviewed_content_hash"), "review_reason": pick(rejected, F.col("reason"), "review_reason"),
    }
    return rows.select(*[new.get(c, F.col(c)) for c in ledger.columns])
