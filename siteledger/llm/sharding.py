"""Sharding by balanced label propagation (operator 2).

Documents are linked through hubs: rows (doc_id, hub) say that all documents of
a hub belong together, which states a group of any size in as many rows. Linked
documents start in an even spread over shards. In each round Spark joins every
document with its hub's count by shard; documents whose hub is stronger in
another shard propose to move there, and each shard admits, hub by hub, as many
as its quota and those that leave it in the same round make room for. Rounds look
at shards with room first; where these admit nothing, documents are exchanged
between full ones. Each move makes a hub's spread less even, so rounds end: when
no hub is split, or exchanges admit nothing IDLE times running, because wishes
left over form no cycle. Hubs that are still split are then gathered: whole hubs
keep their shards, the split ones are laid end to end over the room that is left,
so that a border between two shards cuts one hub at most. That is done where there
are more pieces than that; so hubs have at most one piece a border too many.
Documents without links then fill every shard up to its exact quota, so counts
differ by one at most (law `rows`).

Hubs with many documents are salted in the join, proposals and rows of hubs are
ranked in parts, and all that a round sends to the driver is a few numbers a shard.

Defined cases: a null text has size 8 and crc32 0, and all null texts form one
hub; rows that share an id are placed row by row; an empty table gives an empty
result; very long texts count by their size and are hashed whole; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siteledger.llm.common import ranked, slices, stored

SHARDS = 24
#: Exchanges without a move, each with other ties, after which rounds end.
IDLE = 2
#: A hub with more documents than this is joined in several parts.
SALT_ROWS = 4096


def quota(n: int, shards: int) -> list[int]:
    """Rows of each shard: as even as can be, the first shards one more."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def _ends(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        total += v
        out.append(total)
    return out


def _sums(wishes: DataFrame) -> dict[tuple[int, int | None], int]:
    """Rows by shard and by the shard they wish for: at most (shards + 1) squared numbers."""
    return {(r.shard, r.to): r.n for r in wishes.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()}


def _wishes(linked: DataFrame, shards: int, among: list[int], tie: int) -> DataFrame:
    """Rows (row, hub, n, shard) with to: the shard of those in among in which most
    of the hub is, if that beats the row's own; else null."""
    counts = F.array(*[F.count_if(F.col("shard") == s) for s in range(shards)])
    hubs = linked.groupBy("hub", "n").agg(counts.alias("c"))
    # A hub's shards in order of strength; a hash of both breaks ties.
    force = [F.struct(F.col("c")[s].alias("c"), F.xxhash64("hub", F.lit(s), F.lit(tie)).alias("t"), F.lit(s).alias("shard")) for s in range(shards)]
    best = F.array_max(F.array(*[force[s] for s in among]))
    salts = F.ceil(F.col("n") / SALT_ROWS)
    hubs = hubs.select(F.col("hub").alias("__h"), F.col("c").alias("__c"), best.alias("__best"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("__salt"))
    own = linked.withColumn("__of", F.pmod(F.xxhash64("row"), salts))
    met = own.join(hubs, (own["hub"] == hubs["__h"]) & (own["__of"] == hubs["__salt"]))
    mine = F.struct(F.element_at("__c", F.col("shard") + 1).alias("c"), F.xxhash64("hub", F.col("shard"), F.lit(tie)).alias("t"))
    better = F.struct(F.col("__best.c").alias("c"), F.col("__best.t").alias("t")) > mine
    return met.select("row", "hub", "n", "shard", F.when(F.col("__best").isNotNull() & better, F.col("__best.shard")).alias("to"))


def _granted(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the wanted moves (from, to) fit: no shard gains more than its room."""
    got = dict(wanted)
    while True:
        left = list(room)
        for (s, t), n in got.items():
            left[s] += n
            left[t] -= n
        over = next((t for t in range(len(room)) if left[t] < 0), None)
        if over is None:
            return got
        # Those go first whose staying leaves their own shard within its quota.
        for s in sorted((s for s, t in got if t == over), key=lambda s: -left[s]):
            less = min(got[s, over], -left[over])
            got[s, over] -= less
            left[over] += less


def _admitted(wishes: DataFrame, wanted: dict[tuple[int, int], int], got: dict[tuple[int, int], int]) -> DataFrame:
    """wishes, with those beyond the granted numbers taken back, hub by hub."""
    parts = slices(wishes.sparkSession)
    cut = {k: n for k, n in got.items() if n < wanted[k]}
    limit = F.create_map(*[F.lit(x) for (s, t), n in cut.items() for x in (f"{s},{t}", n)])
    limited = wishes.withColumn("limit", F.element_at(limit, F.concat_ws(",", "shard", F.coalesce("to", F.lit(-1)))))
    spread = F.pmod(F.xxhash64("hub"), F.lit(parts)) * parts + F.pmod(F.xxhash64("row"), F.lit(parts))
    nth = ranked(limited.filter("limit is not null"), ["shard", "to"], ["hub", "row"], "nth", spread, parts * parts)
    kept = nth.select("row", "hub", "n", "shard", F.when(F.col("nth") < F.col("limit"), F.col("to")).alias("to"))
    return limited.filter("limit is null").drop("limit").unionByName(kept)


def propagate(members: DataFrame, n_rows: int, shards: int = SHARDS) -> tuple[DataFrame, list[int]]:
    """Shards for members (row, hub, n: rows of the hub) under the quotas of
    n_rows rows; and the number of members in each shard."""
    quotas = quota(n_rows, shards)
    linked = members.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    loads = [0] * shards
    for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect():
        loads[r.shard] = r.n
    if any(x > q for x, q in zip(loads, quotas)):  # almost all rows are linked: deal them out evenly
        linked = stored(ranked(members, [], ["row"], "__i").withColumn("shard", (F.col("__i") % shards).cast("int")).drop("__i"), "sharding-start")
        loads = quota(sum(loads), shards)
    exchange, idle, tie = False, 0, 0
    while idle < IDLE:
        room = [q - x for q, x in zip(quotas, loads)]
        exchange = exchange or max(room) == 0
        among = [s for s in range(shards) if exchange or room[s] > 0]
        wishes = stored(_wishes(linked, shards, among, tie), "sharding-wishes")
        wanted = {k: n for k, n in _sums(wishes).items() if k[1] is not None}
        if exchange and not wanted:  # all rows are where most of their hub is
            return linked, loads
        got = _granted(wanted, room)
        moved = sum(got.values())
        if moved:
            if got != wanted:
                wishes = stored(_admitted(wishes, wanted, got), "sharding-labels")
            for (shard, to), n in got.items():
                loads[shard] -= n
                loads[to] += n
            linked = wishes.select("row", "hub", "n", F.coalesce("to", "shard").alias("shard"))
        if exchange:
            idle, tie = 0 if moved else idle + 1, tie + 1
        exchange = not moved
    return _gathered(linked, loads, quotas)


def _gathered(linked: DataFrame, loads: list[int], quotas: list[int]) -> tuple[DataFrame, list[int]]:
    """linked with its split hubs laid end to end over the room beside whole ones,
    where there is more than a piece a border too many and that makes fewer; and
    the number of members in each shard."""
    parts = slices(linked.sparkSession)
    pieces = linked.groupBy("hub").agg(F.size(F.collect_set("shard")).alias("p"))  # a number a shard at most
    if (pieces.agg(F.sum(F.col("p") - 1)).first()[0] or 0) < len(quotas):
        return linked, loads
    sizes = F.array(*[F.count_if(F.col("shard") == s) for s in range(len(quotas))])
    split = linked.groupBy("hub", "n").agg(sizes.alias("__c")).withColumn("__pieces", F.size(F.filter("__c", lambda c: c > 0))).filter("__pieces > 1")
    split = stored(split.withColumn("__part", F.pmod(F.xxhash64("hub"), F.lit(parts)).cast("int")), "sharding-split")
    free = [q - x for q, x in zip(quotas, loads)]
    lengths, extra = [0] * parts, 0
    for r in split.groupBy("__part").agg(F.sum("n").alias("n"), F.sum(F.col("__pieces") - 1).alias("extra"), F.array(*[F.sum(F.col("__c")[s]) for s in range(len(quotas))]).alias("c")).collect():  # a row a part
        lengths[r["__part"]], extra = r.n, extra + r.extra
        free = [f + c for f, c in zip(free, r.c)]
    ends = F.array(*[F.lit(e).cast("long") for e in _ends(free)])
    first = F.array(*[F.lit(e - x).cast("long") for e, x in zip(_ends(lengths), lengths)])
    before = F.coalesce(F.sum("n").over(W.partitionBy("__part").orderBy("hub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    laid = split.select(F.col("hub").alias("__h"), (F.element_at(first, F.col("__part") + 1) + before).alias("__start"), "n")
    cut = F.size(F.array_distinct(F.filter(ends, lambda e: (e > F.col("__start")) & (e < F.col("__start") + F.col("n")))))
    if laid.agg(F.sum(cut)).first()[0] >= extra:
        return linked, loads
    laid = laid.drop("n")
    rest = ranked(linked.join(laid, linked["hub"] == laid["__h"], "left_semi"), ["hub"], ["row"], "__j")
    rest = rest.join(laid, rest["hub"] == laid["__h"]).withColumn("__at", F.col("__start") + F.col("__j"))
    rest = rest.select("row", "hub", "n", F.size(F.filter(ends, lambda e: e <= F.col("__at"))).alias("shard"))
    whole = linked.join(laid, linked["hub"] == laid["__h"], "left_anti").select("row", "hub", "n", "shard")
    total, filled = sum(lengths), []
    for f in free:
        filled.append(min(f, total))
        total -= filled[-1]
    return whole.unionByName(rest), [q - f + x for q, f, x in zip(quotas, free, filled)]


def shard_rows(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds shard and slot to stored rows (row: a number of its own; hub: rows
    with equal ones are linked)."""
    # Stored, so that the join is one of two plain tables, whose skewed parts AQE splits.
    groups = stored(rows.groupBy("hub").agg(F.count(F.lit(1)).alias("n")), "sharding-sizes")
    known = stored(rows.select("row", "hub").join(groups, "hub"), "sharding-hubs")
    total = rows.count()
    linked, loads = propagate(known.filter("n > 1"), total, shards)
    ends = _ends([q - x for q, x in zip(quota(total, shards), loads)])
    single = ranked(known.filter("n = 1").select("row"), [], ["row"], "__i")
    single = single.select("row", F.expr(f"cast(size(filter(array({', '.join(f'{e}L' for e in ends)}), e -> e <= __i)) as int)").alias("shard"))
    placed = stored(linked.select("row", "shard").unionByName(single), "sharding-placed")
    return rows.join(ranked(placed, ["shard"], ["row"], "slot"), "row")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text", F.octet_length("text")).alias("hub"),
    )
    out = shard_rows(stored(rows, "sharding-rows"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
