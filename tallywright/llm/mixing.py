"""Mixing sources to target weights by entropy balancing, in DataFrame expressions only.

Each source gets a target number of words. Among all ways to weigh a source's
documents by rates between 0 and `cap` that meet the target, entropy balancing
takes the one nearest to taking each once. Its dual has one variable per source,
and the rates are an exponential tilt of the document sizes:
min(cap, exp(tilt * size / mean size)). Newton's method finds the tilts; each
step is one aggregation of the counts per source and size, in which a bracket
makes up for steps that overshoot. Rates are then rounded into whole copies: the
whole part, and one copy more for documents in the order of a hash over the
rate's fraction until the target is reached.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.llm.common import col, hidden, numbered_repeats, stored

CAP = 3
WEIGHTS = (1, 2, 3)
STEPS = 40
NEAR = 1e-9
BINS = 65536
FILLS = 6
EXACT = "decimal(38,9)"


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: its words, its weight by place in code-point order (NULL last), and its target.

    `sizes` has one row per source and size (`source`, `size`, `n`). Sources share
    all words by weight, none beyond `cap` times its own; what one leaves is
    shared again by weight. Sources sorted by cap over weight are capped up to
    some place and free from there, so running sums replace the repetition.
    The windows run over one row per source.
    """
    per_source = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
    )
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    listed = F.array(*[F.lit(weight) for weight in weights])
    weighed = per_source.withColumn("sid", place).withColumn(
        "weight", F.get(listed, F.pmod(F.col("sid") - 1, F.lit(len(weights))))
    )
    most = F.col("source_size") * cap
    by_ratio = Window.orderBy((most / F.col("weight")).asc(), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum(most).over(before), F.lit(0))) / F.sum("weight").over(onwards)
    capped = weighed.withColumn("most", most).withColumn("total", total).withColumn(
        "capped", F.col("most") <= F.col("weight") * level
    )
    spare = F.col("total") - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0)).over(everything)
    free = F.nullif(F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(everything), F.lit(0))
    shared = (F.col("weight") * spare).cast("double") / free
    return capped.select(
        "sid",
        "source",
        "source_size",
        "least",
        (F.col("source_size") / F.col("docs")).alias("mean"),
        F.when(F.col("capped"), F.col("most").cast("double")).otherwise(shared).alias("target"),
    )


def _rate(size: Column, cap: int) -> Column:
    """Copies of a document of this size, as a fraction; rounded so that the order of sums cannot matter."""
    tilted = F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * size / F.col("mean"), F.lit(50.0))))
    return F.when(F.col("target") <= 0, 0.0).when(F.col("full"), float(cap)).otherwise(F.round(tilted, 9))


def solve(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, steps: int = STEPS) -> DataFrame:
    """Per source its target and its tilt; `sizes` as for `targets`."""
    known = stored(targets(sizes, weights, cap), "mix_targets")
    # At this tilt even the smallest document has the rate that all need on average.
    wanted = F.log(F.col("target") / F.col("source_size")) * F.col("mean") / F.col("least")
    state = known.withColumn("full", F.col("target") >= F.col("source_size") * cap).withColumns(
        {"low": F.least(F.lit(0.0), wanted), "high": F.greatest(F.lit(0.0), wanted), "tilt": F.lit(0.0)}
    )
    x = F.col("size") / F.col("mean")
    uncapped = F.col("tilt") * x < F.log(F.lit(float(cap)))
    for _ in range(steps):
        taken = F.col("n") * F.col("size") * F.exp(F.least(F.col("tilt") * x, F.log(F.lit(float(cap)))))
        moving = state.where("target > 0 and not full").select("sid", F.col("source").alias("s"), "tilt", "mean")
        sums = (
            sizes.join(moving, F.col("source").eqNullSafe(F.col("s")))
            .groupBy("sid")
            .agg(
                F.sum(taken.cast(EXACT)).cast("double").alias("sum"),
                F.sum(F.when(uncapped, taken * x).otherwise(0).cast(EXACT)).cast("double").alias("slope"),
            )
        )
        excess = F.col("sum") - F.col("target")
        low = F.when(excess < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(excess > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - excess / F.nullif(F.col("slope"), F.lit(0.0))
        inside = F.coalesce((newton > F.col("low")) & (newton < F.col("high")), F.lit(False))
        moved = (
            state.join(sums, "sid", "left")
            .withColumns({"low": low, "high": high})
            .withColumn("next", F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2))
            .withColumn("off", F.abs(excess) / F.col("target"))
            .withColumn(
                "tilt", F.when(F.col("off") > NEAR, F.round("next", 11)).otherwise(F.col("tilt"))
            )
        )
        state = stored(moved, "mix_tilts").drop("sum", "slope", "next")
        off = state.agg(F.max("off")).first()[0]
        state = state.drop("off")
        if off is None or off <= NEAR:
            break
    return state.select("sid", "source", "source_size", "target", "mean", "tilt", "full")


def _priority(key: Sequence[Column], fraction: Column) -> Column:
    """Documents with a small value get the extra copy first; a larger fraction makes it smaller."""
    draw = (F.pmod(F.xxhash64(F.lit("mix"), *key), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.when(fraction > 0, draw / fraction)


def _rated(df: DataFrame, plan: DataFrame, cap: int) -> DataFrame:
    """Rows (`source`, `size`, `key`) with their plan, whole copies, priority and its bin."""
    rate = _rate(F.col("size"), cap)
    joined = df.join(plan.withColumnRenamed("source", hidden("s")), F.col("source").eqNullSafe(F.col(hidden("s"))))
    return (
        joined.drop(hidden("s"))
        .withColumn("whole", F.floor(rate).cast("bigint"))
        .withColumn("priority", F.when(F.col("size") > 0, _priority([F.col("key")], rate - F.col("whole"))))
        .withColumn("bin", F.floor(F.col("priority") / (F.col("priority") + 1) * BINS).cast("int"))
        .withColumn("place", F.struct("priority", "key"))
    )


def cuts(df: DataFrame, plan: DataFrame, cap: int = CAP) -> DataFrame:
    """The plan with what decides on extra copies: per source the last place that gets one, and some later ones.

    Words per source and bin of the priority are summed first, so that only the
    rows of the bin in which the target is reached are put in order. A few
    documents that just fit fill what is then left.
    """
    rated = _rated(df, plan, cap)
    per_bin = stored(
        rated.groupBy("sid", "target", "bin").agg(
            F.sum(F.col("whole") * F.col("size")).alias("taken"),
            F.sum(F.when(F.col("bin").isNotNull(), F.col("size")).otherwise(0)).alias("extra"),
        ),
        "mix_bins",
    )
    owed = per_bin.groupBy("sid").agg(
        F.round(F.first("target") - F.sum("taken")).cast("bigint").alias("owed")
    )
    running = Window.partitionBy("sid").orderBy("bin")  # at most BINS rows per source
    reached = (
        per_bin.where("bin is not null")
        .withColumn("upto", F.sum("extra").over(running))
        .join(owed, "sid")
        .groupBy("sid")
        .agg(
            F.first("owed").alias("owed"),
            F.min(F.when(F.col("upto") > F.col("owed"), F.col("bin"))).alias("cut_bin"),
            F.max(F.when(F.col("upto") <= F.col("owed"), F.col("upto"))).alias("before"),
        )
        .withColumn("before", F.coalesce("before", F.lit(0)))
    )
    reached = stored(reached, "mix_reached")
    # Within the bin of the cut, row by row; rows alike in all go together.
    in_bin = rated.join(reached, "sid").where(F.col("bin") == F.col("cut_bin"))
    by_place = Window.partitionBy("sid").orderBy("priority", "key")
    in_bin = in_bin.withColumn("upto", F.col("before") + F.sum("size").over(by_place))
    last = in_bin.where(F.col("upto") <= F.col("owed")).groupBy("sid").agg(
        F.max("place").alias("cut"), F.max("upto").alias("reached")
    )
    state = stored(
        plan.join(reached, "sid", "left")
        .join(last, "sid", "left")
        .withColumn("left", F.col("owed") - F.coalesce("reached", "before"))
        .drop("owed", "before", "reached"),
        "mix_cuts",
    )
    # One copy more of the largest document that still fits, a few times over.
    fills = F.array().cast("array<bigint>")
    state = state.withColumn("fills", fills)
    open_ = _rated(df, state, cap).where((F.col("size") > 0) & (F.col("whole") + _chosen().cast("int") < cap))
    least = stored(open_.groupBy("sid", "size").agg(F.min("key").alias("key")), "mix_open")
    for _ in range(FILLS):
        fit = (
            least.join(state.select("sid", "left", "fills"), "sid")
            .where((F.col("size") <= F.col("left")) & ~F.array_contains("fills", F.col("key")))
            .groupBy("sid")
            .agg(F.max_by("key", "size").alias("fill"), F.max("size").alias("fill_size"))
        )
        filled = (
            state.join(fit, "sid", "left")
            .withColumn("fills", F.when(F.col("fill").isNotNull(), F.concat("fills", F.array("fill"))).otherwise(F.col("fills")))
            .withColumn("left", F.col("left") - F.coalesce("fill_size", F.lit(0)))
            .drop("fill", "fill_size")
        )
        state = stored(filled, "mix_fill")
    return state.drop("left")


def _chosen() -> Column:
    chosen = (
        (F.col("bin") < F.col("cut_bin"))
        | (F.col("bin").isNotNull() & F.col("cut_bin").isNull())
        | ((F.col("bin") == F.col("cut_bin")) & F.coalesce(F.col("place") <= F.col("cut"), F.lit(False)))
    )
    return F.coalesce(chosen, F.lit(False))


def mix(
    df: DataFrame,
    source: str,
    size: Column,
    key: Sequence[str],
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
) -> DataFrame:
    """`df` with `size`, `source_size`, `target`, `copies` and `taken`.

    `size` are the words of a row (NULL: none) and `key` the columns that tell
    rows apart. Rows alike in source and key are numbered, and each number is
    taken or not by itself, so any number of them meets the target. A NULL source
    is a source of its own, after all others. Copies are between 0 and `cap`, so
    `taken`, copies times size, stays within `cap` times the size. The result
    depends on the rows only. An empty table gives no rows; columns called like
    the new ones are replaced.
    """
    names = ("size", "source_size", "target", "copies", "taken")
    kept = [name for name in df.columns if name not in names]
    repeat, cols = hidden("repeat"), [col(name) for name in key]
    numbered = numbered_repeats(df, F.xxhash64(col(source), *cols), repeat)
    told_apart = F.when(F.col(repeat) == 0, F.xxhash64(*cols)).otherwise(F.xxhash64(*cols, F.col(repeat)))
    sized = numbered.select(
        *[col(name).alias(hidden(f"in_{i}")) for i, name in enumerate(kept)],
        col(source).alias("source"),
        F.coalesce(size, F.lit(0)).cast("bigint").alias("size"),
        told_apart.alias("key"),
    )
    narrow = stored(sized.select("source", "size", "key"), "mix_rows")
    sizes = stored(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "mix_sizes")
    plan = cuts(narrow, solve(sizes, weights, cap), cap)
    rated = _rated(sized, plan, cap)
    filled = F.coalesce(F.array_contains("fills", F.col("key")), F.lit(False))
    copies = F.least(F.col("whole") + _chosen().cast("int") + filled.cast("int"), F.lit(cap))
    return rated.select(
        *[F.col(hidden(f"in_{i}")).alias(name) for i, name in enumerate(kept)],
        F.col("size"),
        F.col("source_size"),
        F.col("target"),
        F.when(F.col("size") > 0, copies).otherwise(0).cast("int").alias("copies"),
        F.when(F.col("size") > 0, copies * F.col("size")).otherwise(0).alias("taken"),
    )

