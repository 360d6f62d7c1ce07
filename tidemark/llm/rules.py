"""Quality rules: whole-text rule statistics, fixed limits, and an isolation forest over the statistics.

The forest is fitted on labelled good rows, so that path lengths measure how far a document lies from accepted ones: every tree
draws its rows, as the method says, from half of all of them, within the range of all labelled rows. The threshold is calibrated
on all other labelled rows, by counts of their scores: the largest anomaly score that all but ``tolerance`` of the good ones stay
below, and never below the score that separates the labelled bad rows best. Without labelled rows the forest rejects nothing.

Null texts have no words, so they fail the fixed limits. Every statistic covers the whole text; a text
of any length is one step of its worker. Repeated rows, null keys and foreign columns pass through.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, first_by_hash, map_arrow, table
from tidemark.llm.forest import IsolationForest
from tidemark.session import stage

#: Characters between words, and characters counted as symbols and marks (fixed values).
SPACE, SYMBOLS, MARKS = " \t\n\x0b\x0c\r", "#*$%&|<>", "!?"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A further rule statistic that only the forest sees.
EXTRA = ("n_marks",)
#: Trees of the forest and rows that each draws, as in the method; digits of a score.
TREES, SAMPLE, DIGITS = 100, 256, 5


def statistics(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    n = len(words)
    grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    repeated = 0
    if len(set(grams)) < len(grams):
        twice = {g for g, c in Counter(grams).items() if c > 1}
        covered = np.zeros(n, bool)
        at = np.flatnonzero(np.fromiter((g in twice for g in grams), bool, len(grams)))
        for k in range(5):
            covered[at + k] = True
        repeated = int(covered.sum())
    lines = text.split("\n")
    seen = Counter(line for line in lines if line.strip(SPACE))
    return (
        n, len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), seen.total() - len(seen), repeated, sum(map(text.count, MARKS)),
    )


def with_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, the statistics, and ``x``: the ratios that the forest reads."""
    kind = docs.schema[key].dataType.simpleString()
    names = STATS + EXTRA

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = [statistics(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))] if rows else [batch.column(0), *(pa.array([], pa.int64()) for _ in names)], names=[key, *names])

    return map_arrow(docs.select(key, text), run, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in names))


def ratios(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks) -> np.ndarray:
    """Shares of symbols and of marks, drawn towards zero where a text is short.

    Length, repetition and duplicate lines are left to the fixed limits: among labelled good rows they
    spread so widely that a forest which reads them ranks short good texts above bad ones.
    """
    chars = word_chars + 200.0
    return np.column_stack([np.sqrt(n_symbols / chars), np.sqrt(n_marks / chars)])


def columns(batch: pa.RecordBatch) -> np.ndarray:
    return ratios(*(batch.column(batch.schema.get_field_index(c)).to_numpy() for c in STATS + EXTRA))


def calibrated(good: np.ndarray, bad: np.ndarray, tolerance: float) -> float:
    """The score above which rows are rejected."""
    values = np.unique(np.concatenate([good, bad]))
    counts = [np.bincount(np.searchsorted(values, x), minlength=len(values)) for x in (good, bad)]
    return calibrated_counts(values, *counts, tolerance)


def calibrated_counts(values: np.ndarray, good: np.ndarray, bad: np.ndarray, tolerance: float) -> float:
    """:func:`calibrated` of the distinct scores in ascending order and how many good and bad rows have each."""
    n_good, n_bad = int(good.sum()), int(bad.sum())
    if not n_good:
        return 1.0
    good_below, bad_below = np.cumsum(good), np.cumsum(bad)
    start = int(np.searchsorted(good_below, np.ceil((n_good - 1) * (1 - tolerance)), side="right"))
    if not n_bad:
        return float(np.nextafter(values[good > 0].max(), 2))
    best = start + int(np.argmin((n_good - good_below[start:]) / n_good + bad_below[start:] / n_bad))
    return float(values[best] + values[best + 1]) / 2 if best + 1 < len(values) else float(values[best])


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def labelled_rows(stats: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Statistics and label of every labelled row that passes the fixed limits; ``_half`` is 0 for rows that the forest may be fitted on."""
    known = labels.select(key, F.col(label).alias("_label")).where(F.col("_label").isNotNull() & F.col(key).isNotNull()).distinct()
    half = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("half")), F.lit(2))
    return stats.where(~base_failed()).dropDuplicates([key]).join(known, key).withColumn("_half", half)


def fitted(rows: DataFrame, key: str, seed: int) -> tuple[IsolationForest | None, bool]:
    """The forest, and whether it had to be fitted on both halves. Range and counts are those of all rows; each tree draws its
    own rows, as an isolation forest does, from all good rows of its half."""
    good, chars = F.col("_label") == 1, F.col("word_chars") + F.lit(200.0)
    shares = {"_s": F.sqrt(F.col("n_symbols") / chars), "_m": F.sqrt(F.col("n_marks") / chars)}
    least = rows.withColumns(shares).agg(*[f(c) for f in (F.min, F.max) for c in shares], F.count_if(good), F.count_if(good & (F.col("_half") == 0))).first()
    if least[4] < 2:
        return None, False
    both = least[5] < 2
    drawn = first_by_hash(rows.where(good if both else good & (F.col("_half") == 0)), key, TREES * SAMPLE).orderBy(key).toPandas()
    x = ratios(*(drawn[c].to_numpy() for c in STATS + EXTRA))
    return IsolationForest(x, (np.array(least[0:2]), np.array(least[2:4])), TREES, SAMPLE, seed), both


def apply_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", tolerance: float = 0.002, seed: int = 7) -> DataFrame:
    """Key, the five statistics, base_failed, anomaly (null if base_failed) and kept of every row."""
    stats = stage(with_statistics(docs, key, text), "statistics")
    rows = stage(labelled_rows(stats, labels, key, label), "labelled")
    forest, both = fitted(rows, key, seed)
    judged = scored(stats, forest, key)
    cut = 1.0
    if forest:
        # the threshold comes from all good rows that the forest was not fitted on and from all bad rows
        held = scored(rows.where((F.col("_label") != 1) | (F.col("_half") == 1) | F.lit(both)), forest, key, ("_label",))
        counts = held.groupBy("anomaly").agg(F.count_if(F.col("_label") == 1).alias("good"), F.count_if(F.col("_label") == 0).alias("bad")).orderBy("anomaly").toPandas()  # 10 ** DIGITS at most
        cut = calibrated_counts(*(counts[c].to_numpy() for c in ("anomaly", "good", "bad")), tolerance)
    failed = base_failed()
    return judged.select(key, *STATS, failed.alias("base_failed"), F.when(~failed, F.col("anomaly")).alias("anomaly"), (~failed & (F.col("anomaly") <= F.lit(cut))).alias("kept"))


def scored(stats: DataFrame, forest: IsolationForest | None, key: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Key, the five statistics, ``more`` and the anomaly score in ``DIGITS`` digits, so that scores of any number of rows can be counted."""
    model = stats.sparkSession.sparkContext.broadcast(forest)
    kept = [key, *STATS, *more]
    schema = ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Batches) -> Batches:
        trees = model.value
        for batch in batches:
            score = trees.scores(columns(batch)) if trees and batch.num_rows else np.zeros(batch.num_rows)
            keep = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.round(score, DIGITS))], names=[*kept, "anomaly"])

    return map_arrow(stats, run, schema + ", anomaly double")


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
