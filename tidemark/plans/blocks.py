"""The first of the next rows that reaches a level, for horizons of any length.

An array of the next ``horizon`` rows for each row costs rows x horizon. Here rows are numbered along their series and
cut into blocks of about the root of the horizon, and each block keeps its rows and its extremes:

1. the rest of a row's own block is looked through;
2. the extremes of the blocks that the horizon reaches, one short array for each block, name the first block that holds a touch;
3. the row meets that block by an equi join and looks through it.

So a row sees three arrays of about the root of the horizon, whatever the data, and no block has more rows than that.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.chunks import Series, number_rows, over_chunks, same_keys
from tidemark.session import stage


def first_hit(path: Column, test) -> Column:
    """1-based place of the first element of ``path`` that passes, null if none does."""
    return F.nullif(F.array_position(F.transform(path, test), True), F.lit(0))


def first_touches(df: DataFrame, series: Series, horizon: int, tests: dict[str, tuple[str, str, Column]]) -> DataFrame:
    """Add ``_pos`` and ``_n``, the place of a row in its series and the length of the series, and for each test how many rows ahead the first touch is.

    ``tests`` maps a name to (column of the later rows, ``>=`` or ``<=``, level of the row). Null without a touch among the next ``horizon`` rows.
    """
    if horizon < 1:
        raise ValueError("horizon must be 1 or more")
    keys, size = list(series.keys), max(8, isqrt(horizon))
    levels = {f"_level_{n}": level for n, (_, _, level) in tests.items()}
    rows = stage(number_rows(df.withColumns(levels), series, "_pos", "_n"), "rows").withColumn("_block", F.expr(f"_pos div {size}"))

    def touch(n: str, field: str):
        """Test of an element of an array by its ``field``."""
        level = F.col(f"_level_{n}")
        return (lambda x: x[field] >= level) if tests[n][1] == ">=" else (lambda x: x[field] <= level)

    seen = {c: f"_v{i}" for i, c in enumerate(dict.fromkeys(c for c, _, _ in tests.values()))}
    extremes = [(F.max if op == ">=" else F.min)(c).alias(n) for n, (c, op, _) in tests.items()]
    rest = F.sort_array(F.collect_list(F.struct("_pos", *[F.col(c).alias(v) for c, v in seen.items()])))
    blocks = rows.groupBy(*keys, "_block").agg(rest.alias("_rows"), F.struct(*extremes).alias("_extremes"))
    count = (horizon + size - 1) // size
    by_block = Series(keys=series.keys, order=("_block",), rows_per_chunk=max(16 * count, series.rows_per_chunk // size))
    ahead = over_chunks(stage(blocks, "blocks"), by_block, lambda c: {"_ahead": F.collect_list("_extremes").over(c.next(count))}, after=count)
    blocks = stage(ahead.drop("_extremes"), "blocks").withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)} | {"_block": "_at"})

    def meet(d: DataFrame, right: DataFrame, at: str, how: str) -> DataFrame:
        return d.join(right, same_keys(d, right, [(k, f"_k{i}") for i, k in enumerate(keys)]) & (d[at] == right["_at"]), how)

    d = meet(rows, blocks, "_block", "inner")
    found: dict[str, Column] = {}
    for n, (c, _, _) in tests.items():
        own = first_hit(F.slice("_rows", (F.col("_pos") % size + 2).cast("int"), F.lit(size)), touch(n, seen[c]))
        found[n] = own
        found[f"_far_{n}"] = F.when(own.isNull(), F.col("_block") + first_hit(F.col("_ahead"), touch(n, n)))
    d = d.select(*rows.columns, *[v.alias(k) for k, v in found.items()])
    for n, (c, _, _) in tests.items():
        # Rows without a block to look through go to places that no block has, each block's rows to their own.
        d = d.withColumn(f"_far_{n}", F.coalesce(f"_far_{n}", -1 - F.col("_block")))
        d = meet(d, blocks.select(*[f"_k{i}" for i in range(len(keys))], "_at", "_rows"), f"_far_{n}", "left")
        hit = F.col("_at") * size + first_hit(F.col("_rows"), touch(n, seen[c])) - 1 - F.col("_pos")
        first = F.coalesce(n, hit)
        d = d.withColumn(n, F.when(first <= horizon, first)).drop("_rows", "_at", f"_far_{n}", *[f"_k{i}" for i in range(len(keys))])
    return d.select(*df.columns, "_pos", "_n", *tests)
