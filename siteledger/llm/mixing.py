"""Mixing sources to target weights with a splitting tree (operator 8).

The documents of each source are put in a random but reproducible order and cut
into blocks of about BLOCK_WORDS words. A source's target says how many of its
blocks are drawn: all of them once per full epoch, and the first ones of the
order for the rest. These exact block quotas are then dealt to output shards by
a tree: a node splits its quotas between its two halves by a multivariate
hypergeometric draw, source by source, so each leaf gets a random share of each
source and all leaves the same number of blocks (give or take one). A leaf's
blocks are the next ones of each source's order; inside a shard documents are
shuffled by a hash. The last document of a source's quota is cut at the word
where the target is met.

Everything runs as DataFrame and SQL expressions. Running sums over a source go
through partial sums by slice of the order, so no source is sorted in one task;
the tree's nodes hold one number a source.

Defined cases: a null text has size 0 and is never drawn; a null source is a
source of its own, last in order; a source without words has target 0; repeated
ids are separate rows; a very long text spans several blocks and is drawn with the
one it begins in; an empty table gives an empty mix; extra columns pass through
`mixed_documents` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siteledger.llm.common import row_key, slices, stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 2048
SHARDS = 64
SEED = 7
#: A draw looks this many standard deviations to both sides of its mean.
REACH = 9
#: Beyond this standard deviation (millions of blocks) a draw is the normal
#: quantile rounded to a whole number, which is off by less than 1 / WIDE in
#: probability; sums stay exact, and no draw walks over a window that grows.
WIDE = 1000

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight and target from rows (source, source_size).

    Sources in code-point order, null last, weigh 5, 2, 1, repeating. Targets
    share the total by weight but stop at MAX_EPOCHS times a source's size;
    what is over is shared again. With sources in order of size per weight, the
    ones that stop are the first ones, so one running sum finds the level at
    which the rest share.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    rows = sizes.withColumn("__n", F.row_number().over(order) - 1)
    pick = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("__n") % len(WEIGHTS) + 1).cast("int"))
    rows = rows.withColumn("weight", pick).withColumn("__cap", (MAX_EPOCHS * F.col("source_size")).cast("double"))
    whole = W.partitionBy()
    by_level = W.orderBy(F.col("__cap") / F.col("weight"), "__n")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    rows = (
        rows.withColumn("__total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("__left", F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
        .withColumn("__rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("__stops", F.col("__cap") * F.col("__rest") <= F.col("__left") * F.col("weight"))
    )
    # Sources that stop come before those that share; the first that shares sets the level.
    first_free = F.min(F.when(~F.col("__stops"), F.col("__cap") / F.col("weight"))).over(whole)
    rows = rows.withColumn("__first", first_free)
    level = F.max(F.when(~F.col("__stops") & (F.col("__cap") / F.col("weight") == F.col("__first")), F.col("__left") / F.col("__rest"))).over(whole)
    rows = rows.withColumn("__level", level)
    target = F.when(F.col("__stops"), F.col("__cap")).otherwise(F.col("__level") * F.col("weight"))
    return rows.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def placed(docs: DataFrame, slices_: int) -> DataFrame:
    """docs (with size, source, __key) and __start: words before the document in
    its source's order, by partial sums over slices of that order."""
    rows = docs.withColumn("__slice", (F.shiftrightunsigned("__key", 40) * slices_ / F.lit(float(1 << 24))).cast("int"))
    parts = rows.groupBy("source", "__slice").agg(F.sum("size").alias("__words"))
    before = W.partitionBy("source").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("__s"), F.col("__slice").alias("__p"), F.coalesce(F.sum("__words").over(before), F.lit(0)).alias("__base"))
    inner = W.partitionBy("source", "__slice").orderBy("__key", "__row").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return rows.join(parts, rows["source"].eqNullSafe(parts["__s"]) & (rows["__slice"] == parts["__p"])).withColumn("__start", F.col("__base") + F.col("__in")).drop("__s", "__p", "__base", "__in", "__slice")


def _ln_factorial(n: str) -> str:
    """SQL for ln(n!), by Stirling's series from 8 on."""
    small = "element_at(array(0D, 0D, 0.6931471805599453D, 1.791759469228055D, 3.1780538303479458D, 4.787491742782046D, 6.579251212010101D, 8.525161361065415D), cast(%s + 1 as int))"
    x = f"({n})"
    series = f"({x} + 0.5D) * ln(cast({x} as double)) - {x} + 0.9189385332046727D + 1D / (12D * {x}) - 1D / (360D * {x} * {x} * {x})"
    return f"(case when {x} < 8 then {small % x} else {series} end)"


def hypergeometric(good: str, bad: str, n: str, u: str) -> str:
    """SQL for a hypergeometric draw: how many of n items drawn without return
    from good + bad items are good, by inversion of the uniform number u."""
    # The window's sum is bound once, so the walk is linear in its width.
    lo0, hi0 = f"greatest(0L, {n} - {bad})", f"least({n}, {good})"
    total = f"({good} + {bad})"
    mean = f"(cast({n} as double) * {good} / {total})"
    sd = f"sqrt({mean} * (cast({bad} as double) / {total}) * (({total} - {n}) / greatest(1D, {total} - 1D)))"
    lo = f"greatest({lo0}, cast(floor({mean} - {REACH} * {sd}) as bigint) - 2)"
    hi = f"least({hi0}, cast(ceil({mean} + {REACH} * {sd}) as bigint) + 2)"
    mode = f"least({hi0}, greatest({lo0}, cast(floor({mean}) as bigint)))"

    def ln_p(k: str) -> str:
        return f"-({_ln_factorial(k)} + {_ln_factorial(f'{good} - {k}')} + {_ln_factorial(f'{n} - {k}')} + {_ln_factorial(f'{bad} - {n} + {k}')})"

    weigh = f"transform(sequence({lo}, {hi}), k -> exp({ln_p('k')} - top))"
    weights = f"transform(array({ln_p(mode)}), top -> {weigh})[0]"
    pick = (
        "transform(array({w}), w -> transform(array({u} * aggregate(w, 0D, (a, b) -> a + b)), most -> {lo} + aggregate(w, named_struct('sum', 0D, 'n', 0L), "
        "(s, x) -> named_struct('sum', s.sum + x, 'n', s.n + if(s.sum + x < most, 1L, 0L)), s -> s.n))[0])[0]"
    )
    drawn = pick.format(w=weights, lo=lo, u=u)
    # A second uniform number from the first one's low digits, for a normal one by Box and Muller.
    normal = f"sqrt(-2D * ln({u})) * cos(2D * pi() * ({u} * 1048576D - floor({u} * 1048576D)))"
    wide = f"least({hi0}, greatest({lo0}, cast(round({mean} + {sd} * ({normal})) as bigint)))"
    return f"(case when {total} <= 0 or {n} <= 0 then 0L when {lo0} = {hi0} then {lo0} when {sd} > {WIDE} then {wide} else least({hi}, {drawn}) end)"


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """shard and quotas (array of struct source, q) from one row of all quotas.

    Each level of the tree is one narrow step; a node that stands for one shard
    stays as it is."""
    nodes = quotas.select("quotas", F.lit(0).alias("first"), F.lit(shards).alias("n"))
    while shards > 1:
        uniform = f"(pmod(xxhash64({seed}, node.first, node.n, q.source), 9007199254740992L) + 0.5D) / 9007199254740992D"
        draw = hypergeometric("q.q", "(s.left - q.q)", "s.take", uniform)
        total = "aggregate(quotas, 0L, (a, q) -> a + q.q)"
        # The left half takes its shards' part of all blocks.
        folded = (
            f"aggregate(quotas, named_struct('left', {total}, 'take', cast(floor({total} * (n div 2) / n) as bigint), 'mine', cast(array() as array<bigint>)), "
            f"(s, q) -> transform(array({draw}), d -> named_struct('left', s.left - q.q, 'take', s.take - d, 'mine', concat(s.mine, array(d))))[0], s -> s.mine)"
        ).replace("node.first", "first").replace("node.n", "n")
        nodes = nodes.withColumn("__mine", F.when(F.col("n") > 1, F.expr(folded)))
        left = "named_struct('quotas', transform(quotas, (q, i) -> named_struct('source', q.source, 'q', __mine[i])), 'first', first, 'n', n div 2)"
        right = "named_struct('quotas', transform(quotas, (q, i) -> named_struct('source', q.source, 'q', q.q - __mine[i])), 'first', first + n div 2, 'n', n - n div 2)"
        same = "named_struct('quotas', quotas, 'first', first, 'n', n)"
        nodes = nodes.select(F.explode(F.expr(f"if(n > 1, array({left}, {right}), array({same}))")).alias("x")).select("x.*")
        shards -= shards // 2
    return nodes.select(F.col("first").alias("shard"), "quotas")


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The draws of docs (as `sized` gives them), and all of docs with source_size and target.

    Draws: the columns of docs, epoch, block, shard, position (order inside the
    shard) and words, those that the draw takes of the document (all but for
    the last document of a source's quota)."""
    rows = docs.withColumn("__key", F.xxhash64(F.lit(seed), "doc_id", "__tie"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes)
    size = F.col("source_size")
    quotas = targets.withColumn("want", F.round("target").cast("long")).select(
        "source", "source_size", "target",
        F.when(size > 0, F.expr("want div source_size")).otherwise(0).cast("long").alias("__full"),
        F.when(size > 0, F.expr("want % source_size")).otherwise(0).cast("long").alias("__rest"),
        F.ceil(size / BLOCK_WORDS).cast("long").alias("__blocks"),
    ).withColumn("__q", F.col("__full") * F.col("__blocks") + F.ceil(F.col("__rest") / BLOCK_WORDS))
    quotas = stored(quotas, "mixing-quotas").coalesce(1)  # one short row a source
    one = quotas.agg(F.array_sort(F.collect_list(F.struct("source", F.col("__q").alias("q")))).alias("quotas"))
    leaves = split_quotas(one, shards, seed).select("shard", F.explode("quotas").alias("x")).select("shard", F.col("x.source").alias("source"), F.col("x.q").alias("q"))
    upto = W.partitionBy("source").orderBy("shard")
    ends = leaves.withColumn("end", F.sum("q").over(upto)).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("shard", "end"))).alias("ends"))
    ends = ends.select(F.col("source").alias("__s"), F.transform("ends", lambda x: x["end"]).alias("__ends"))
    quotas = quotas.join(ends, quotas["source"].eqNullSafe(ends["__s"])).drop("__s").withColumnRenamed("source", "__s")
    quotas = stored(quotas, "mixing-leaves")
    at = placed(rows, 4 * slices(docs.sparkSession))
    known = at.join(quotas, at["source"].eqNullSafe(quotas["__s"])).drop("__s")
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__full")))
    drawn = known.filter("size > 0").select("*", epochs.alias("epoch")).withColumn("block", F.floor(F.col("__start") / BLOCK_WORDS))
    words = F.when(F.col("epoch") < F.col("__full"), F.col("size")).otherwise(F.least(F.col("size"), F.col("__rest") - F.col("__start")))
    drawn = drawn.withColumn("words", words).filter("words > 0")
    nth = F.col("epoch") * F.col("__blocks") + F.col("block")
    # The shard whose share of the source's draws holds this one: how many shares end before it.
    drawn = drawn.withColumn("__nth", nth).withColumn("shard", F.expr("size(filter(__ends, e -> e <= __nth))"))
    drawn = drawn.withColumn("position", F.xxhash64(F.lit(seed + 1), "shard", "epoch", "__key"))
    inner = ["__key", "__start", "__full", "__rest", "__blocks", "__q", "__ends", "__nth"]
    return drawn.drop(*inner, "source_size", "target"), known.drop(*inner)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, a hash of the text, and a number of the row; stored,
    so the numbers stay."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("__tie"), F.monotonically_increasing_id().alias("__row"))
    return stored(rows, "mixing-sizes")


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as it is drawn, all its columns
    kept; the last document of a source's quota ends where the target is met.

    Rows come shard by shard and shuffled inside each, so files written from the
    result follow that order. Rows are numbered in a stored copy: equal rows have
    draws of their own."""
    columns = docs.columns
    at = {c: f"c{k}" for k, c in enumerate(columns)}
    kept = stored(docs.toDF(*at.values()).withColumn("row", F.monotonically_increasing_id()), "mixing-rows")
    text = F.col(at["text"])
    rows = kept.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["source"]).alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("__tie"), F.col("row").alias("__row"))
    draws = mix(stored(rows, "mixing-sizes"), shards, seed)[0].select(F.col("__row").alias("row"), "size", "words", "shard", "position")
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), "")).otherwise(text)
    drawn = kept.join(draws, "row").withColumn(at["text"], cut)
    # A shard's draws spread evenly over positions, so ranges of (shard, position) are parts of even size.
    parts = 4 * slices(docs.sparkSession)
    place = (F.col("shard") + (F.shiftrightunsigned("position", 11) / F.lit(float(1 << 53)))) / shards
    dealt = drawn.withColumn("part", F.least(F.floor(place * parts), F.lit(parts - 1)).cast("int"))
    ordered = dealt.repartition(slices(docs.sparkSession), "part").sortWithinPartitions("part", "shard", "position")
    return ordered.select(*at.values()).toDF(*columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's draws are those of its blocks in the tree's leaves: taken
    sums their words, shards names the leaf and position of each."""
    draws, known = mix(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    place = F.struct("shard", "position")
    taken = draws.groupBy("__row").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(place)).alias("places"))  # MAX_EPOCHS draws at most
    out = known.join(taken, "__row", "left")
    shards = F.coalesce(F.array_join(F.transform("places", lambda p: p["shard"].cast("string")), ","), F.lit(""))
    positions = F.coalesce(F.array_join(F.transform("places", lambda p: p["position"].cast("string")), ","), F.lit(""))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), shards.alias("shards"), positions.alias("positions"))
