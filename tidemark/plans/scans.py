"""Linear recurrences along sorted rows, many series in one Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(df: DataFrame, head: Column, recurrences: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Add ``_A_<name>`` and ``_B_<name>``: y[t] = A[t] y + B[t] for y[t] = factor[t] y[t-1] + addend[t], y the value before the first row.

    ``recurrences`` maps a name to (factor, addend). Rows must stand sorted within their partition, and a series whole in one
    partition; ``head`` marks its first row. The maps of a batch are composed in rounds of doubling distance, all series at
    once, and the last row of a batch carries on into the next one.
    """
    names = list(recurrences)
    given = [*df.columns]
    df = df.withColumns({"_head": head, **{f"_{p}_{n}": v.cast("double") for n, fg in recurrences.items() for p, v in zip("AB", fg)}})
    schema = T.StructType([*df.schema.fields[: len(given)], *(T.StructField(f"_{p}_{n}", T.DoubleType()) for n in names for p in "AB")])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        carried = [(1.0, 0.0)] * len(names)
        for batch in batches:
            if not len(batch):
                continue
            heads = batch.column(len(given)).to_numpy(zero_copy_only=False).astype(bool)
            starts = np.flatnonzero(heads)
            at = np.arange(len(batch))
            place = at - np.concatenate([[0], starts])[np.searchsorted(starts, at, side="right")]
            going_on = slice(0, int(starts[0]) if len(starts) else len(batch))  # rows of the series that the last batch ended in
            steps = []
            d = 1
            while d <= int(place.max()):
                steps.append((d, np.flatnonzero(place >= d)))
                d *= 2
            out = []
            for k in range(len(names)):
                a, b = (np.array(batch.column(len(given) + 1 + 2 * k + j).to_numpy(zero_copy_only=False), float) for j in (0, 1))
                for d, rows in steps:
                    b[rows] += a[rows] * b[rows - d]
                    a[rows] *= a[rows - d]
                a0, b0 = carried[k]
                b[going_on] += a[going_on] * b0
                a[going_on] *= a0
                carried[k] = (float(a[-1]), float(b[-1]))
                out += [pa.array(a), pa.array(b)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(given)], *out], names=schema.names)

    return df.mapInArrow(run, schema)
