"""Planning automatic fixes, and following up on their state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.functions.rules import finding_rules, fix_targets

CAP = 3


def tier_of(rows: DataFrame, tier: int) -> DataFrame:
    rules = finding_rules(rows.sparkSession).filter(F.col("tier") == tier).select("finding_type")
    return rows.join(F.broadcast(rules), "finding_type", "left_semi")  # 23 rules


def tier1_plan(ledger: DataFrame, changes: DataFrame, graduation: DataFrame, cap: int | None = CAP, targets: DataFrame | None = None) -> DataFrame:
    """What to do about open tier-1 rows, by priority, then key: open, skip as a
    duplicate, or skip for want of a fixer; and whether to merge at once.

    A row is a duplicate if a change of its key is open, if another type's
    change to the same file is open, or if another type took the file earlier
    in this plan (the first type to be opened for a file keeps it). After cap
    openings the plan ends, so later rows are not in it; without a cap it goes on.

    Nothing is ordered as a whole: who takes a file is the least row of the file,
    and where the plan ends is the last of the first cap openings."""
    spark = ledger.sparkSession
    rows = tier_of(ledger.filter("status = 'open'"), 1).select("stable_key", "finding_type", "priority_score")
    rows = rows.join(F.broadcast(targets if targets is not None else fix_targets(spark)), "finding_type", "left")
    live = changes.filter("status = 'open'")
    rows = rows.join(live.select("stable_key", F.lit(True).alias("__same")).distinct(), "stable_key", "left")
    # Open changes by file and type: as few rows as there are fix targets.
    files = live.select("finding_type").distinct().join(F.broadcast(fix_targets(spark) if targets is None else targets), "finding_type").groupBy("target_file").agg(F.collect_set("finding_type").alias("__types"))
    rows = rows.join(F.broadcast(files), "target_file", "left")
    other = F.coalesce(F.exists("__types", lambda t: t != F.col("finding_type")), F.lit(False))
    blocked = F.coalesce("__same", F.lit(False)) | other
    can = ~blocked & F.coalesce("has_fixer", F.lit(False))
    rows = rows.withColumn("__blocked", blocked).withColumn("__can", can)
    rows = rows.withColumn("__at", F.struct((-F.col("priority_score")).alias("p"), "stable_key"))
    first = rows.filter("__can").groupBy("target_file").agg(F.min(F.struct("__at", "finding_type")).alias("__first"))
    rows = rows.join(F.broadcast(first), "target_file", "left")  # a row a target file
    rows = rows.withColumn("__taker", F.when(F.col("__first.__at") <= F.col("__at"), F.col("__first.finding_type")))
    late = F.col("__can") & (F.col("__taker") != F.col("finding_type"))
    # A row without a fixer is a duplicate too if the file was taken before it.
    taken = ~F.col("__blocked") & F.col("__taker").isNotNull() & (F.col("__taker") != F.col("finding_type"))
    action = F.when(F.col("__blocked") | late | taken, "skippedDuplicate").when(F.col("__can"), "open").otherwise("skippedNoFixer")
    rows = rows.withColumn("action", action)
    if cap is not None:
        end = rows.filter("action = 'open'").select("__at").orderBy("__at").limit(cap).agg(F.max("__at").alias("__end"), F.count(F.lit(1)).alias("__n"))
        rows = rows.crossJoin(F.broadcast(end)).filter((F.col("__n") < cap) | (F.col("__at") <= F.col("__end")))  # one row
    ready = graduation.filter("auto_merge_eligible").select("finding_type", F.lit(True).alias("__ready"))
    rows = rows.join(F.broadcast(ready), "finding_type", "left")  # a row a finding type
    merge = (F.col("action") == "open") & F.coalesce("__ready", F.lit(False))
    return rows.select("stable_key", "finding_type", "target_file", "priority_score", "action", merge.alias("auto_merge"))


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in (("open", "opened"), ("skippedDuplicate", "skipped_duplicate"), ("skippedNoFixer", "skipped_no_fixer"))])


def record_opened(changes: DataFrame, plan: DataFrame, contents: DataFrame) -> DataFrame:
    """changes (stable_key, finding_type, status, file_path, previous_content) with a
    row for each opening of plan: merged at once where the plan says so, else open;
    contents (file_path, content) say what the file held before, null if unknown."""
    held = contents.select(F.col("file_path").alias("target_file"), F.col("content").alias("previous_content"))
    rows = plan.filter("action = 'open'").join(F.broadcast(held), "target_file", "left")  # a row a target file
    new = rows.select("stable_key", "finding_type", F.when(F.col("auto_merge"), "merged").otherwise("open").alias("status"), F.col("target_file").alias("file_path"), "previous_content")
    return changes.select(*new.columns).unionByName(new)


def record_reverts(changes: DataFrame, reverts: DataFrame) -> DataFrame:
    """changes with the rows of impact.revert_plan: the content to go back to is in
    them, so they hold no earlier one themselves."""
    new = reverts.select("stable_key", "finding_type", "status", "file_path", F.lit(None).cast("string").alias("previous_content"))
    return changes.select(*new.columns).unionByName(new)


def sync_changes(changes: DataFrame, status: DataFrame) -> DataFrame:
    """changes with the state that status (pr_number, state, merged) reports for
    open ones: still open, merged, or closed."""
    s = status.select("pr_number", F.col("state").alias("__state"), F.col("merged").alias("__merged")).dropDuplicates(["pr_number"])
    new = F.when(F.col("__state") == "open", "open").when(F.col("__merged"), "merged").otherwise("closed")
    rows = changes.join(s, "pr_number", "left")
    known = (F.col("status") == "open") & F.col("__state").isNotNull()
    return rows.select(*[F.when(known, new).otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in changes.columns])
