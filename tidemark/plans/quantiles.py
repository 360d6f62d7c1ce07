"""Exact interpolated percentiles per group, for groups of any size.

``percentile`` keeps every distinct value of a group in one buffer. Here a mergeable sketch first
brackets each wanted rank, everything outside the brackets is reduced to counts before the
shuffle, and only the narrow bracket is ranked exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ACCURACY = 500_000
_SMALL_GROUP = 200_000


def exact_percentiles(
    df: DataFrame,
    keys: list[str],
    value: Column,
    qs: dict[str, float],
    accuracy: int = _ACCURACY,
    small_group: int = _SMALL_GROUP,
) -> DataFrame:
    """One row per group: keys and one column per entry of ``qs`` (linear interpolation)."""
    v = df.select(*keys, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    margin = 2.0 / accuracy + 3.0 / small_group
    names = list(qs)
    points = [p for n in names for p in (max(qs[n] - margin, 0.0), min(qs[n] + margin, 1.0))]
    sketch = v.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.percentile_approx("_v", points, accuracy).alias("_s")
    )
    inf = float("inf")
    whole = F.col("_n") <= small_group
    brackets = {}
    for i, n in enumerate(names):
        brackets[f"_lo{i}"] = F.when(whole, F.lit(-inf)).otherwise(F.col("_s")[2 * i])
        brackets[f"_hi{i}"] = F.when(whole, F.lit(inf)).otherwise(F.col("_s")[2 * i + 1])
    sketch = sketch.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n", *[c.alias(n) for n, c in brackets.items()]
    )
    if keys:
        on = None
        for i, k in enumerate(keys):
            c = v[k].eqNullSafe(sketch[f"_k{i}"])
            on = c if on is None else on & c
        joined = v.join(sketch, on)
    else:
        # Without keys the sketch is a single row.
        joined = v.withColumn("_one", F.lit(1)).join(F.broadcast(sketch.withColumn("_one", F.lit(1))), "_one")
    inside = F.lit(False)
    zone = F.lit(0)
    for i in range(len(names)):
        inside = inside | F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
        zone = zone + (F.col("_v") > F.col(f"_hi{i}")).cast("int")
    counted = (
        joined.withColumns({"_g": F.when(inside, F.col("_v")), "_zone": zone})
        .groupBy(*keys, "_g", "_zone")
        .agg(F.count("_v").alias("_c"), F.max("_v").alias("_m"), F.first("_n").alias("_n"))
    )
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_cum", F.sum("_c").over(w))
    aggs = []
    for i, n in enumerate(names):
        at = (F.col("_n") - 1) * F.lit(qs[n])
        below = F.floor(at) + 1
        above = F.least(below + 1, F.col("_n"))
        aggs += [
            F.min(F.when(F.col("_cum") >= below, F.col("_m"))).alias(f"_x{i}"),
            F.min(F.when(F.col("_cum") >= above, F.col("_m"))).alias(f"_y{i}"),
        ]
    out = ranked.groupBy(*keys).agg(*aggs, F.first("_n").alias("_n"))
    cols = []
    for i, n in enumerate(names):
        at = (F.col("_n") - 1) * F.lit(qs[n])
        cols.append((F.col(f"_x{i}") + (F.col(f"_y{i}") - F.col(f"_x{i}")) * (at - F.floor(at))).alias(n))
    return out.select(*keys, *cols)
