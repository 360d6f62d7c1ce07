"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted-shingle similarity.

A window is a run of as many words as an item has (the whole text where it has fewer). Words are lower-cased
runs of letters and digits. The fingerprint of a window weighs each 5-word shingle by its count. An index over the
items holds, for each block of the fingerprint, every value within ``NEAR`` bits of an item's block: with
``BLOCKS`` blocks and ``radius`` < BLOCKS * (NEAR + 1), a window within the radius of an item meets it in at
least one block, so the index finds all of them. Candidates within the radius are verified by the weighted
Jaccard similarity of their shingles.

Two texts without a common shingle have similarity 0, so windows are fingerprinted only where they hold a shingle
of the benchmark; this bounds the work and loses nothing. Texts and items shorter than five words have one
shingle, all their words. Items without words match nothing; null texts and items count as empty. The
benchmark is read in slabs of ``SLAB_BYTES``, each broadcast and matched in a pass of its own over the documents,
so its size is not bounded by one machine. Repeated documents give repeated rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import Batches, map_arrow, table

SHINGLE, BLOCKS, NEAR = 5, 7, 2
SLAB_BYTES = 8 << 20
WORD = re.compile(r"[^\W_]+")
#: Where each of the seven blocks of 64 bits begins.
EDGES = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
#: Windows that are compared at once.
STEP = 1 << 14


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)] if len(words) > SHINGLE else [" ".join(words)] if words else []


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(sums > 0, axis=1, bitorder="little")).view(np.uint64)[:, 0]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity."""
    both = sum((a & b).values())
    return both / (a.total() + b.total() - both)


class Items:
    """A slab of the benchmark with its shingle set and, for each window length, its index of blocks."""

    def __init__(self, rows: list[tuple], radius: int):
        if not 0 <= radius < BLOCKS * (NEAR + 1):
            raise ValueError(f"radius must be below {BLOCKS * (NEAR + 1)}")
        self.radius = radius
        self.keys, self.bags, self.known = [], [], set()
        by_length: dict[int, list[int]] = defaultdict(list)
        prints = []
        for key, text in rows:
            words = words_of(text or "")
            if not words:
                continue
            bag = shingles(words)
            by_length[len(words)].append(len(self.keys))
            self.keys.append(key)
            self.bags.append(Counter(bag))
            self.known.update(bag)
            prints.append(packed(signs(hashes(bag)).sum(axis=0, keepdims=True))[0])
        self.prints = np.array(prints, np.uint64)
        self.vocabulary = {w for s in self.known for w in s.split(" ")}
        self.index = {n: self._indexed(at) for n, at in by_length.items()}
        self.short = {n for n in by_length if n < SHINGLE}

    def _indexed(self, at: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Places of the items, and for each block a table of value -> which of them are near."""
        tables = []
        for k in range(BLOCKS):
            width = EDGES[k + 1] - EDGES[k]
            own = (self.prints[at] >> np.uint64(EDGES[k])) & np.uint64((1 << width) - 1)
            tables.append(np.bitwise_count(np.arange(1 << width, dtype=np.uint64)[:, None] ^ own[None, :]) <= NEAR)
        return np.array(at), tables

    def near(self, n: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of window and item of length n within the radius, and their distances."""
        at, tables = self.index[n]
        meets = np.zeros((len(fp), len(at)), bool)
        for k, t in enumerate(tables):
            meets |= t[(fp >> np.uint64(EDGES[k])) & np.uint64(len(t) - 1)]
        w, i = np.nonzero(meets)
        d = np.bitwise_count(fp[w] ^ self.prints[at[i]])
        good = d <= self.radius
        return w[good], at[i[good]], d[good]

    def matches(self, text: str, least: float) -> list[tuple]:
        """(item, first word, words, distance, similarity) of the best window of each item that is found."""
        words = words_of(text)
        found = self._found(words)
        if not found.any() and not self._short_hit(words):
            return []
        bag = shingles(words)
        sums = np.zeros((len(bag) + 1, 64), np.int32)
        np.cumsum(signs(hashes(bag)), axis=0, out=sums[1:])
        best: dict[int, tuple] = {}
        before = np.concatenate([[0], np.cumsum(found)])
        for n in self.index:
            size = max(1, n - SHINGLE + 1)  # shingles of a window
            if n < SHINGLE:
                rows = self._short_windows(words, n)
            elif len(words) <= n:
                size = len(bag)
                rows = np.flatnonzero(before[size:] - before[:1] > 0)[:1]
            else:
                rows = np.flatnonzero(before[size:] - before[:-size] > 0)
            for s in range(0, len(rows), STEP):
                at = rows[s : s + STEP]
                if n < SHINGLE:
                    own = [[" ".join(words[i : i + n])] for i in at]
                    fp = np.array([packed(signs(hashes(b)).sum(axis=0, keepdims=True))[0] for b in own], np.uint64)
                else:
                    fp = packed(sums[at + size] - sums[at])
                for w, item, d in zip(*self.near(n, fp)):
                    start = int(at[w])
                    bag_w = Counter(bag[start : start + size]) if n >= SHINGLE else Counter([" ".join(words[start : start + n])])
                    sim = similarity(bag_w, self.bags[item])
                    if sim >= least and (item not in best or (-sim, start) < best[item][0]):
                        best[item] = ((-sim, start), (self.keys[item], start, min(n, len(words)), int(d), sim))
        return [row for _, row in best.values()]

    def _found(self, words: list[str]) -> np.ndarray:
        """Which shingles of a text the benchmark has; only those whose words it all has are looked up."""
        known = np.fromiter(map(self.vocabulary.__contains__, words), bool, len(words))
        size = min(SHINGLE, len(words))
        full = known[: len(words) - size + 1].copy() if size else known
        for k in range(1, size):
            full &= known[k : len(words) - size + 1 + k]
        for i in np.flatnonzero(full):
            full[i] = " ".join(words[i : i + size]) in self.known
        return full

    def _short_windows(self, words: list[str], n: int) -> np.ndarray:
        return np.array([i for i in range(len(words) - n + 1) if " ".join(words[i : i + n]) in self.known], np.int64)

    def _short_hit(self, words: list[str]) -> bool:
        return any(len(self._short_windows(words, n)) for n in self.short)


def hashes(bag: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s) for s in bag], np.uint64)


def slabs(benchmark: DataFrame, item: str, text: str):
    """Lists of (item, text) of bounded size."""
    rows, size = [], 0
    for r in benchmark.select(item, text).toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1] or "")
        if size > SLAB_BYTES:
            yield rows
            rows, size = [], 0
    yield rows


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", radius: int = 20, least: float = 0.8) -> DataFrame:
    """(key, item, start_word, n_words, hamming, similarity): the best window of every document and item at ``least`` or more."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType
    item_type = to_arrow_type(item_kind)
    out = None
    for rows in slabs(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Batches, shared=shared) -> Batches:
            items = Items(shared.value, radius)
            for batch in batches:
                key_type = batch.schema.field(0).type
                got = [(k, *m) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in items.matches(t or "", least)]
                cols = list(zip(*got)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (key_type, item_type, pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=["k", "i", "start_word", "n_words", "hamming", "similarity"])

        one = map_arrow(docs.select(key, text), run, f"k {kind}, i {item_kind.simpleString()}, start_word long, n_words long, hamming int, similarity double")
        out = one if out is None else out.unionByName(one)
    return out.select(F.col("k").alias(key), F.col("i").alias(item), "start_word", "n_words", "hamming", "similarity")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", radius: int = 20, least: float = 0.8) -> DataFrame:
    """The documents in which no window matches an item, all columns; one narrow pass for each slab."""
    at = docs.columns.index(text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for rows in slabs(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Batches, shared=shared) -> Batches:
            items = Items(shared.value, radius)
            for batch in batches:
                yield batch.filter(pa.array([not items.matches(t.as_py() or "", least) for t in batch.column(at)], pa.bool_()))

        docs = map_arrow(docs, run, kinds)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
