"""Periodic runs of words: a run-length grammar by recompression answers how far two places of a text agree.

A run is a stretch of words with smallest period q that no neighbouring word extends, of ``exponent * q`` words or more.

1. Harmonic grid: a run of period p covers four places kp, (k+1)p, (k+2)p, (k+3)p with the same word. Only such places are
   candidates, n log n of them are looked at in a text of n words, and those inside a run that is known already are passed over.
2. Texts with candidates become a grammar by recompression: in turn, blocks of equal symbols get a name for symbol and length, and
   pairs of a left symbol and a right symbol get a name for both. Equal stretches of words get equal names but at their ends.
3. The grammar says how far two places agree to the right and to the left: a walk up while names are equal, then down to the
   differing word, O(log n) steps with whole blocks as one step. Both answers give the exact ends of a candidate's run.
4. Of equal stretches the smallest period stays. Words after the first period of a run are left out of the collapsed text.

Null and empty texts have no words and no runs. Repeated rows and tied keys are kept, each with its answer. A text is one row of
work whatever its length; candidates are made ``CHUNK`` at a time. An empty table gives no rows. Only key and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, map_arrow, ranges, raw_texts, steps, table

#: Bytes of text that one step handles, and grid places looked at together.
TEXT_BYTES, CHUNK = 4 << 20, 1 << 21
WORD = "[^\\x20\\x09-\\x0D]+"
ODD = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:long,length:long,period:long>>"


def named(code: np.ndarray) -> np.ndarray:
    return np.unique(code, return_inverse=True)[1].astype(np.int64)


class Grammar:
    """All levels of the grammar of a row of symbols, one node after the other; level 0 comes first.

    The first and last symbol, and one between any two texts, must be separators: symbols that occur once.
    """

    def __init__(self, symbols: np.ndarray, separators: int):
        sym, size = symbols.astype(np.int64), np.ones(len(symbols), np.int64)
        levels: list[dict[str, np.ndarray]] = []
        base, turn, first, last = 0, 0, np.full(len(sym), -1, np.int64), np.full(len(sym), -1, np.int64)
        while True:
            n = len(sym)
            level = {"sym": sym, "size": size, "first": first, "last": last, "ahead": np.ones(n, np.int64), "behind": np.ones(n, np.int64), "parent": np.full(n, -1, np.int64)}
            levels.append(level)
            if n <= 2 * separators:
                break
            starts = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
            if len(starts) < n:  # blocks of equal symbols
                counts = np.diff([*starts, n])
                code = sym[starts] * (counts.max() + 1) + counts
                at = np.arange(n) - np.repeat(starts, counts)
                level["ahead"], level["behind"] = np.repeat(counts, counts) - at, at + 1
            else:  # pairs of a left and a right symbol
                turn += 1
                right = ((sym.view(np.uint64) + np.uint64(turn)) * ODD >> np.uint64(40) & np.uint64(1)).astype(bool)
                second = np.concatenate([[False], ~right[:-1] & right[1:]])
                starts = np.flatnonzero(~second)
                counts = np.diff([*starts, n])
                code = sym[starts] * (sym.max() + 2) + np.where(counts == 2, sym[starts + counts - 1] + 1, 0)
            level["parent"] = base + n + np.repeat(np.arange(len(starts)), counts)
            first, last = base + starts, base + starts + counts - 1
            size = np.add.reduceat(size, starts)
            sym, base = named(code), base + n
        for name in ("sym", "size", "ahead", "behind", "parent", "first", "last"):
            setattr(self, name, np.concatenate([level[name] for level in levels]))

    def agree(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """Number of equal symbols from the places a and b on, to the right or to the left."""
        edge, reach, move = (self.first, self.ahead, 1) if forward else (self.last, self.behind, -1)
        x, y, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        live, rising = np.arange(len(a)), np.ones(len(a), bool)
        while len(live):
            same = self.sym[x] == self.sym[y]
            k = np.where(same, np.minimum(reach[x], reach[y]), 0)
            out[live] += k * self.size[x]
            x, y = x + move * k, y + move * k
            above, beside = self.parent[x], self.parent[y]
            rise = same & rising & (above >= 0) & (edge[above] == x) & (edge[beside] == y)
            below, under = edge[x], edge[y]
            x = np.where(rise, above, np.where(same, x, below))
            y = np.where(rise, beside, np.where(same, y, under))
            rising &= same
            if not (go := same | (below >= 0)).all():
                live, x, y, rising = live[go], x[go], y[go], rising[go]
        return out


def smallest(runs: np.ndarray) -> np.ndarray:
    """Of (start, length, period) rows of one stretch the one with the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])] if len(runs) else runs


def find_runs(ids: np.ndarray, lengths: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """(start, length, period) rows, by start and period; ids of all texts stand one after the other, starts count from the first."""
    offset = np.cumsum(lengths) - lengths
    text_of = np.repeat(np.arange(len(lengths)), lengths)
    periods = lengths // exponent
    text, period = np.repeat(np.arange(len(lengths)), periods), ranges(periods, np.ones(len(periods), np.int64))
    order = np.argsort(period, kind="stable")
    text, period = text[order], period[order]
    count = (lengths[text] - 1) // period - (exponent - 2)
    done = np.cumsum(count)
    reach, inside = np.zeros(len(ids), np.int64), np.ones(len(ids), np.int64)
    built: set[int] = set()
    grammar, place = None, np.zeros(len(ids), np.int64)
    found, at, chunk = [np.zeros((0, 3), np.int64)], 0, min(CHUNK, 1 << 14)
    while at < len(count):
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + chunk, side="right")))
        chunk = min(CHUNK, 2 * chunk)  # small periods first, so that their multiples are known
        c, p = count[at:stop], np.repeat(period[at:stop], count[at:stop])
        i = np.repeat(offset[text[at:stop]], c) + ranges(c, np.zeros(len(c), np.int64)) * p
        at = stop
        for k in range(exponent - 1):
            hit = np.flatnonzero(ids[i + k * p] == ids[i + (k + 1) * p])
            i, p = i[hit], p[hit]
        known = (reach[i] > i + (exponent - 1) * p) & (p % inside[i] == 0)
        i, p = i[~known], p[~known]
        if not len(i):
            continue
        wanted = set(np.unique(text_of[i]).tolist())
        if not wanted <= built:
            built |= wanted
            chosen = np.array(sorted(built))
            size = lengths[chosen]
            own = ranges(size, offset[chosen])
            place[own] = np.arange(len(own)) + np.repeat(np.arange(1, len(chosen) + 1), size)
            symbols = np.empty(len(own) + len(chosen) + 1, np.int64)
            between = np.ones(len(symbols), bool)
            between[place[own]] = False
            symbols[place[own]] = ids[own]
            symbols[between] = ids.max() + 1 + np.arange(len(chosen) + 1)
            grammar = Grammar(symbols, len(chosen) + 1)
        right = grammar.agree(place[i], place[i + p], True)
        left = grammar.agree(place[i] - 1, place[i + p] - 1, False)
        runs = np.stack([i - left, left + p + right, p], axis=1)
        runs = smallest(runs[runs[:, 1] >= np.maximum(least, exponent * p)])
        found.append(runs)
        runs = runs[np.argsort(runs[:, 0] + runs[:, 1], kind="stable")]
        cover = ranges(runs[:, 1], runs[:, 0])
        end, q = np.repeat(runs[:, 0] + runs[:, 1], runs[:, 1]), np.repeat(runs[:, 2], runs[:, 1])
        more = end > reach[cover]
        reach[cover[more]], inside[cover[more]] = end[more], q[more]
    runs = smallest(np.concatenate(found))
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def answers(texts: list[bytes], least: int, exponent: int) -> list[tuple[list[dict], dict | None, bytes]]:
    """Runs, the run of greatest exponent, and the collapsed text, of every text."""
    words = [t.split() for t in texts]  # bytes are split at the six white-space characters of ASCII only
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.empty(int(lengths.sum()), object)
    flat[:] = [w for own in words for w in own]
    ids = pd.factorize(flat)[0].astype(np.int64)
    runs = find_runs(ids, lengths, least, exponent)
    offset = np.cumsum(lengths) - lengths
    kept = np.zeros(len(ids) + 1, np.int64)
    np.add.at(kept, runs[:, 0] + runs[:, 2], 1)
    np.add.at(kept, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(kept[:-1]) == 0
    first = np.searchsorted(runs[:, 0], [*offset, len(ids)])
    out = []
    for k, own in enumerate(words):
        mine = [(int(s - offset[k]), int(n), int(p)) for s, n, p in runs[first[k] : first[k + 1]]]
        best = None
        for run in mine:
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        if mine:
            own = [w for w, keep in zip(own, kept[offset[k] : offset[k] + lengths[k]].tolist()) if keep]
        name = lambda r: {"start": r[0], "length": r[1], "period": r[2]}
        out.append((list(map(name, mine)), name(best) if best else None, b" ".join(own)))
    return out


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """Key, ``runs`` (by start, then period), ``best`` (greatest length/period, then smallest start and period; null without runs) and ``collapsed`` text of every row."""
    if exponent < 2 or least < 1:
        raise ValueError("exponent must be 2 or more, least 1 or more")
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = raw_texts(batch.column(1))
            for s, e in steps(texts, TEXT_BYTES):
                runs, best, collapsed = zip(*answers(texts[s:e], least, exponent))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s, e - s), pa.array(runs, pa.list_(item)), pa.array(best, item), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["key", "runs", "best", "collapsed"]
                )

    kind = docs.schema[key].dataType.simpleString()
    got = map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, runs {RUNS}, best struct<start:long,length:long,period:long>, collapsed string")
    return got.withColumnRenamed("key", key)


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with the words of every tenth text made periodic from a place on, as the contract of the query says; a null key or text stays."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    df = docs.withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_words"))
    a = g % F.col("_n")
    p = 1 + F.floor((F.col("_n") - a) / (3 + g % 8))
    df = df.withColumn("_a", F.when(F.col("_n") > 0, a)).withColumn("_p", F.when(F.col("_n") > 0, p))

    def taken(i: Column) -> Column:
        return F.element_at("_words", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int") + 1)

    changed = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), taken), " ")
    return df.withColumn(text, F.when(F.col("_n") > 0, changed).otherwise(F.col(text))).drop("_words", "_n", "_a", "_p")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.array_join(F.transform(line, lambda s: F.concat(s, F.lit("\n"))), "")
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("(best.length * 1000L) div best.period")
    return got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
