"""Building blocks that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile_cuts(df: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: int, per_cut: int = 32) -> DataFrame:
    """Per key that holds at least one of about `cuts` quantiles of all rows by (keys, order): `_cuts`, the sorted quantiles in it.

    The quantiles come from the cuts * per_cut rows of smallest hash, a repeatable sample of fixed size, so a key has quantiles as its
    share of all rows has them, wherever its values lie.
    """
    drawn = df.select(*keys, F.struct(*order).alias("_o")).orderBy(F.xxhash64(*keys, *order), *keys, "_o").limit(cuts * per_cut)
    # The sample is of fixed size: one task numbers it.
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys, "_o"))
    chosen = drawn.withColumn("_place", place).filter(F.col("_place") % per_cut == 0)
    return chosen.groupBy(*keys).agg(F.array_sort(F.collect_set("_o")).alias("_cuts"))


def balanced_row_number(
    df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = (), out: str = "rn", cuts: int | None = None,
) -> DataFrame:
    """1-based row number per key by (order, ties), the same plan for keys of any size.

    About `cuts` quantiles of all rows (twice the shuffle partitions by default) cut the keys they fall into into slices; each slice
    is numbered on its own and shifted by the rows of the slices before it. Only rows equal in key, order and ties can't be told
    apart. Both broadcast sides have at most one row per quantile and per slice of a key with quantiles.
    """
    keys, by = list(keys), [order, *ties]
    cuts = cuts or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = quantile_cuts(df, keys, by, cuts)
    before = F.size(F.filter("_cuts", lambda c: c <= F.struct(*by)))
    tagged = df.join(F.broadcast(bounds), keys, "left").withColumn("_cut", F.coalesce(F.when(F.col("_cuts").isNotNull(), before), F.lit(0)))
    upto = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        tagged.filter(F.col("_cuts").isNotNull()).groupBy(*keys, "_cut").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(upto), F.lit(0))).drop("_rows"))
    local = F.row_number().over(Window.partitionBy(*keys, "_cut").orderBy(*by))
    return (
        tagged.drop("_cuts").withColumn("_local", local)
        .join(F.broadcast(shift), [*keys, "_cut"], "left")
        .withColumn(out, (F.col("_local") + F.coalesce("_shift", F.lit(0))).cast("long"))
        .drop("_cut", "_local", "_shift"))


def value_bucket(v: Column) -> Column:
    """Monotone bucket of a double: about half a percent wide, so a few thousand cover any usual value range."""
    scaled = F.floor(F.log1p(F.abs(v) * 1000.0) * 200.0)
    top = 2**30
    return (
        F.when(v == float("inf"), F.lit(top))
        .when(v == float("-inf"), F.lit(-top))
        .otherwise((F.signum(v) * scaled).cast("long"))
    )


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated percentiles: one row (keys, p, percentile) per key and requested p.

    Distinct values are counted where they lie, a small histogram of monotone buckets locates the wanted ranks, and
    only the buckets that hold a wanted rank are ordered. No group is ever held by one task or on the driver: the order needs the values
    dealt by bucket anyway, so the joins by bucket ask for sort-merge.
    """
    keys = list(keys)
    dummy = [] if keys else ["_g"]
    if not keys:
        df = df.withColumn("_g", F.lit(1))
    g = keys or dummy
    counts = (
        df.select(*g, F.col(value).cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .withColumn("_v", F.when(F.col("_v") == 0.0, F.lit(0.0)).otherwise(F.col("_v")))
        .groupBy(*g, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", value_bucket(F.col("_v")))
    )
    upto = Window.partitionBy(*g).orderBy("_b")
    hist = (
        counts.groupBy(*g, "_b")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_cum", F.sum("_bn").over(upto))
        .withColumn("_tot", F.sum("_bn").over(Window.partitionBy(*g)))
    )
    h = F.col("p") / 100.0 * (F.col("_tot") - 1)
    ranks = (
        hist.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])))
        .withColumn("_k", F.explode(F.array_distinct(F.array(F.floor(h), F.ceil(h)))))
        .filter((F.col("_k") >= F.col("_cum") - F.col("_bn")) & (F.col("_k") < F.col("_cum")))
        .select(*g, "_b", "p", "_k", (F.col("_cum") - F.col("_bn")).alias("_base"), h.alias("_h"))
    )
    wanted = ranks.groupBy(*g, "_b").agg(F.first("_base").alias("_base"))
    ordered = counts.join(wanted.hint("merge"), [*g, "_b"]).withColumn(
        "_end", F.col("_base") + F.sum("_n").over(Window.partitionBy(*g, "_b").orderBy("_v"))
    ).select(*g, "_b", "_v", "_n", "_end")
    hits = ranks.join(ordered.hint("merge"), [*g, "_b"]).filter(
        (F.col("_k") < F.col("_end")) & (F.col("_k") >= F.col("_end") - F.col("_n"))
    )
    lo = F.max(F.when(F.col("_k") == F.floor("_h"), F.col("_v")))
    hi = F.max(F.when(F.col("_k") == F.ceil("_h"), F.col("_v")))
    frac = F.max(F.col("_h") - F.floor("_h"))
    return (
        hits.groupBy(*g, "p")
        .agg(lo.alias("_lo"), hi.alias("_hi"), frac.alias("_f"))
        .select(*keys, "p", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
                .otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("percentile"))
    )


def percentile_columns(df: DataFrame, keys: Sequence[str], value: str, named: dict[str, float]) -> DataFrame:
    """Wide form of :func:`exact_percentiles`: one column per name."""
    long = exact_percentiles(df, keys, value, sorted(set(named.values())))
    picks = [F.max(F.when(F.col("p") == float(p), F.col("percentile"))).alias(n) for n, p in named.items()]
    return long.groupBy(*keys).agg(*picks) if keys else long.agg(*picks)
