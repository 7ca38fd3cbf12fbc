"""Summary statistics that stay exact without gathering a group's raw values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.session import cut


def tally(df: DataFrame, value: Column, group: Sequence[str], name: str = "v") -> DataFrame:
    """Distinct values with counts: the pre-aggregation every exact quantile here starts from."""
    return df.filter(value.isNotNull()).groupBy(*group, value.alias(name)).agg(F.count("*").alias("n"))


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[c])
    return out


def ranked_values(counts: DataFrame, group: Sequence[str], value: str = "v", n: str = "n") -> DataFrame:
    """``counts(group, value, n)`` with ``before``, the rows of the group that come before the value, and ``total``.

    Two levels: the values are dealt by ranges of (group, value), so a large group fills many parts and
    a part holds a bounded share of the table; what lies before a part comes from one number a part.
    No group is ever in one task.  The counts are written first, as dealing by ranges reads them twice.
    """
    spark = counts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(cut(counts).repartitionByRange(tasks, *group, value).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy(*group, "part").agg(F.sum(n).alias("held"))
    whole = Window.partitionBy(*group)
    sums = sums.withColumns({"total": F.sum("held").over(whole),
                             "earlier": F.coalesce(F.sum("held").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    own = Window.partitionBy(*group, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("before", F.coalesce(F.sum(n).over(own), F.lit(0)))
    joined = inside.join(sums.drop("held"), _same(inside, sums, group) & (inside["part"] == sums["part"]))
    return joined.select(*[inside[c].alias(c) for c in (*group, value, n)], (inside["before"] + sums["earlier"]).alias("before"), sums["total"].alias("total"))


def quantiles(df: DataFrame, value: Column, probabilities: Sequence[float], group: Sequence[str],
              names: Sequence[str], places: int | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """Linear-interpolated quantiles per group from the ranks of its values, for any number of rows and different values.

    A group keeps two numbers per probability; ``extra`` are aggregates of its values ``v`` and counts ``n``.
    """
    ranked = ranked_values(tally(df, value, group), group)
    aggregates, steps = [], []
    for i, p in enumerate(probabilities):
        place = (F.col("total") - 1) * F.lit(float(p))
        for end, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            holds = (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
            aggregates.append(F.max(F.when(holds, F.col("v").cast("double"))).alias(f"{end}{i}"))
        far = (F.col("total_") - 1) * F.lit(float(p))
        low, high = F.floor(far), F.ceil(far)
        steps.append(F.when(low == high, F.col(f"lo{i}")).otherwise((high - far) * F.col(f"lo{i}") + (far - low) * F.col(f"hi{i}")))
    rows = ranked.groupBy(*group).agg(F.max("total").alias("total_"), *aggregates, *extra)
    picked = [F.round(c, places) if places is not None else c for c in steps]
    rest = [c for c in rows.columns if c not in (*group, "total_") and not (c[:2] in ("lo", "hi") and c[2:].isdigit())]
    return rows.select(*group, *[c.alias(n) for c, n in zip(picked, names)], *rest)


def describe(df: DataFrame, value: Column, group: Sequence[str], places: int = 6) -> DataFrame:
    """min, mean, median, max and n over non-null values, rounded; n = 0 groups stay with nulls."""
    counts = df.groupBy(*group, value.alias("v")).agg(F.count("*").alias("n"))
    live = F.when(F.col("v").isNotNull(), F.col("n"))
    base = counts.groupBy(*group).agg(
        F.round(F.min("v").cast("double"), places).alias("min"),
        F.round(F.sum(F.col("v") * F.col("n")) / F.sum(live), places).alias("mean"),
        F.round(F.max("v").cast("double"), places).alias("max"),
        F.coalesce(F.sum(live), F.lit(0)).alias("n"))
    middle = quantiles(df, value, [0.5], group, ["median"], places)
    both = base.join(middle, _same(base, middle, group), "left")
    return both.select(*[base[c].alias(c) for c in group], "min", "mean", "median", "max", "n")
