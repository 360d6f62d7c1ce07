"""SimHash near-duplicates: exact links within a Hamming radius by bit-sliced comparison.

1. Every text becomes a 64-bit fingerprint of its word shingles (XXH64 of each shingle, majority per bit).
2. Equal fingerprints collapse to one row, so copies never meet each other again.
3. A fingerprint is cut into 8 bytes. Two fingerprints within ``radius`` bits agree on at least
   ``8 - radius`` bytes, so each is dealt once for every choice of that many bytes (28 for radius 2).
   A bucket holds distinct fingerprints that share 48 bits, so it has at most 65,536 members whatever the data.
4. Buckets are compared with bit planes: plane p holds bit p of 64 fingerprints in a word. Distances of
   many pairs are counted at once by carry-save counters, and words whose lanes are all beyond the
   radius leave the comparison early. A bucket gives a spanning tree of its links, not its pairs.
5. The links are joined up by ``components``; documents take the smallest id of their component.

Null and empty texts have fingerprint zero and link like any other. Null ids never become the smallest
id unless all ids of a component are null. Repeated rows are kept, each with the same answer. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, map_arrow, raw_texts, table
from tidemark.llm.components import components
from tidemark.session import stage

#: For a byte, a word with its bit j in lane j; 255 of them can be added without overflow.
SPREAD = np.array([sum((b >> j & 1) << 8 * j for j in range(8)) for b in range(256)], np.uint64)
#: Buckets of more members are searched member by member; smaller ones share one comparison.
SMALL = 16
#: Copies beyond which a fingerprint is answered by broadcast, and how many such fingerprints there can be.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def shingle_hashes(text: bytes, words: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of every run of ``words`` words, A-Z in lower case, joined by spaces; of all words if there are fewer."""
    parts = text.lower().split()
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(joined, seed)] if parts else []
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    return [h(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :].tolist())]


def fingerprint(hashes: list[int]) -> int:
    """A bit is 1 if more than half of the hashes have it; zero without hashes."""
    n = len(hashes)
    h = np.zeros((n + 254) // 255 * 255, np.uint64)
    h[:n] = hashes
    lanes = SPREAD[h.view(np.uint8)].reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64)
    count = lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: Column, text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): one row for each document."""
    rows = docs.select(key.alias("id"), F.col(text).alias("text"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            fp = np.array([fingerprint(shingle_hashes(t, words, seed)) for t in raw_texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def planes_of(fp: np.ndarray) -> np.ndarray:
    """(64, words): bit p of every fingerprint, 64 fingerprints in a word; spare lanes are zero."""
    padded = np.zeros(-(-len(fp) // 64) * 64, np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within(differ, words: int, radius: int, planes: int = 64) -> np.ndarray:
    """Lanes whose number of set planes is at most ``radius``, as words.

    ``differ(p, at)`` gives plane p of the differences for the words ``at``. Counters are carry-save:
    one word for each binary digit, and one that says a lane has overflowed.
    """
    digits = [np.zeros(words, np.uint64) for _ in range((radius + 1).bit_length())]
    over = np.zeros(words, np.uint64)
    at = np.arange(words)
    out = np.zeros(words, np.uint64)

    def beyond() -> np.ndarray:
        more, equal = over.copy(), ~over
        for k in reversed(range(len(digits))):
            if radius >> k & 1:
                equal = equal & digits[k]
            else:
                more |= equal & digits[k]
                equal = equal & ~digits[k]
        return more

    for p in range(planes):
        carry = differ(p, at)
        for k in range(len(digits)):
            digits[k], carry = digits[k] ^ carry, digits[k] & carry
        over = over | carry
        if p % 8 == 7 and p < planes - 1:
            alive = ~beyond() != 0
            if not alive.any():
                return out
            if not alive.all():
                at, over, digits = at[alive], over[alive], [d[alive] for d in digits]
    out[at] = ~beyond()
    return out


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


def small_links(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places within the radius; members of a group stand together and are few."""
    a, b = [], []
    for d in range(1, SMALL):
        i = np.flatnonzero(group[d:] == group[:-d])
        if not len(i):
            break
        left, right = planes_of(fp[i]), planes_of(fp[i + d])
        hit = lanes(within(lambda p, at, x=left, y=right: x[p, at] ^ y[p, at], left.shape[1], radius), len(i))
        a.append(i[hit])
        b.append(i[hit] + d)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def large_links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of one group: each member is compared with all others once, as it is reached."""
    planes, n = planes_of(fp), len(fp)
    words = planes.shape[1]
    one = np.uint64(0xFFFFFFFFFFFFFFFF)
    fresh, a, b = np.ones(n, bool), [], []
    for first in range(n):
        if not fresh[first]:
            continue
        fresh[first], queue = False, [first]
        while queue:
            q = int(fp[(i := queue.pop())])
            near = lanes(within(lambda p, at, q=q: planes[p, at] ^ (one if q >> p & 1 else np.uint64(0)), words, radius), n)
            near = near[fresh[near]]
            fresh[near] = False
            queue += near.tolist()
            a += [i] * len(near)
            b += near.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that hold their components together."""
    if not 0 <= radius <= 4:
        raise ValueError("radius must lie between 0 and 4")
    kept = list(combinations(range(8), 8 - radius))

    def deal(batches: Batches) -> Batches:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            parts = fp.view(np.uint8).reshape(-1, 8).astype(np.int64)
            for t, chosen in enumerate(kept):
                key = np.full(len(fp), t if len(chosen) < 8 else 0, np.int64)
                for c in chosen:
                    key = key << 8 | parts[:, c]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], names=["key", "fp"])

    def link(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff([*starts, len(key)])
        group, sizes = np.repeat(np.arange(len(starts)), size), np.repeat(size, size)
        few = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
        i, j = small_links(fp[few], group[few], radius)
        a, b = [fp[few][i]], [fp[few][j]]
        for s, n in zip(starts[size > SMALL], size[size > SMALL]):
            i, j = large_links(own := fp[s : s + n], radius)
            a.append(own[i])
            b.append(own[j])
        return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)

    def compare(batches: Batches) -> Batches:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last key, which may go on in the next batch

        def out(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            a, b = link(np.concatenate([k for k, _ in rows]), np.concatenate([f for _, f in rows]))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            if (cut := int(np.searchsorted(key, key[-1]))) or (held and held[-1][0][-1] != key[-1]):
                yield out([*held, (key[:cut], fp[:cut])])
                held = []
            held.append((key[cut:], fp[cut:]))
        if held:
            yield out(held)

    dealt = map_arrow(distinct.select("fp"), deal, "key long, fp long")
    return map_arrow(dealt.repartition("key").sortWithinPartitions("key"), compare, "a long, b long")


def group_documents(found: DataFrame, radius: int = 2) -> DataFrame:
    """(id, fp, component_id) for rows (id, fp); component_id is the smallest id that links reach."""
    found = stage(found, "fingerprints")
    distinct = stage(found.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "distinct")
    return answered(found, distinct, links(distinct, radius))


def answered(found: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fp, component_id) for rows (id, fp), their distinct (fp, first, n) and the links between those.

    Fingerprints with more copies than ``HOT_ROWS`` and than one in ``HOT_KEYS`` rows are at most ``HOT_KEYS`` in number,
    so their answers are broadcast and their rows stay where they are; the others meet their answers by fingerprint.
    """
    member = components(edges)
    first = member.join(distinct, member.node == distinct.fp).groupBy("root").agg(F.min("first").alias("component"))
    linked = member.join(first, "root").select(F.col("node").alias("fp"), "component")
    answer = stage(distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("component", "first").alias("component_id")), "answers")
    rows = distinct.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(answer.where(F.col("n") > max(HOT_ROWS, rows // HOT_KEYS)).drop("n"))
    rest = found.join(hot.select("fp"), "fp", "left_anti").join(answer.drop("n"), "fp")
    return found.join(hot, "fp").unionByName(rest).select("id", "fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """Key, fingerprint (16 hex digits) and component_id of every row."""
    got = group_documents(fingerprints(docs, F.col(key), text, words), radius)
    return got.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
