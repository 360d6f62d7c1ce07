"""Near-duplicates by exact Jaccard similarity of word shingles: MinHash buckets, wide SimHash fingerprints in bit planes, exact sets.

1. A text becomes the set of the hashes of its word shingles; texts with equal sets collapse to one. A set has ``BANDS`` keys
   from ``ROWS`` minimum hashes each. Sets of similarity s share a key with probability 1 - (1 - s^4)^28: a pair at 0.8 is passed
   over in 4 of 10 million cases, a closer one less often still. (Blocks of a SimHash cannot deal the sets themselves: those
   that keep every pair at 0.8 hold a constant share of all pairs.) Sets that share a key with another one get a SimHash of ``BITS`` bits.
2. Every set is compared with the smallest set of each of its buckets. Then members of a bucket that are not joined up yet are
   compared with each other. So a large group of near copies costs a star, not its pairs.
3. Both comparisons are those of ``simhash``: bit planes, carry-save counters, words of 64 pairs that end early. At 0.8 two
   fingerprints differ in 155 of 1024 bits (deviation 11), at 0.5 in 274, so texts that share a header or a licence fall out
   here, before any set is moved. ``radius`` lies nearly five deviations beyond 0.8.
4. Buckets of more than ``LIMIT`` members are compared block by block, each pair of blocks in a task of its own.
5. What is left is decided by the sets. Pairs of a star are rows, at most ``BANDS`` for a set. Inside a bucket pairs never become rows:
   the fingerprints name the members that have a pair, these bring their sets (blocks hold ``HASHES`` of them besides), and a block gives a
   spanning forest. Links are joined up by ``components``; rows take the smallest id of their component.
6. Texts stay where they are: a bitmap of row numbers, a bit for each row, is broadcast and names those whose fingerprints are needed, or which go.

Null and empty texts have the empty set and are alike. Repeated rows are kept apart by their row number. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, map_arrow, ranges, raw_texts, steps
from tidemark.llm.components import components
from tidemark.llm.simhash import SPREAD, answered, lanes, shingle_hashes, within
from tidemark.session import stage

BANDS, ROWS, BLOCK = 28, 4, 2048
#: Bits of a fingerprint; members of a bucket that one task compares; pairs that one step compares.
BITS, LIMIT, STEP = 1024, 4096, 1 << 20
#: Hashes of the sets that a block holds, about, if it has several members; rows in a bitmap (as many as bitmap_construct_agg has bits).
HASHES, BITMAP = 1 << 20, 1 << 15
#: Bytes of text whose sets leave a worker together.
TEXT_BYTES = 1 << 20
#: A bijection of 64 bits for each minimum and for each word of the fingerprint: exclusive or, then an odd factor.
MASKS, FACTORS = np.random.default_rng(8).integers(0, 0xFFFFFFFFFFFFFFFF, (2, BANDS * ROWS + BITS // 64, 1), np.uint64)
FACTORS |= np.uint64(1)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def band_keys(own: np.ndarray) -> list[int]:
    """One signed key for each band of a set that is not empty."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for s in range(0, len(own), BLOCK):
        least = np.minimum(least, ((own[s : s + BLOCK] ^ MASKS[: BANDS * ROWS]) * FACTORS[: BANDS * ROWS]).min(axis=1))
    raw = least.tobytes()
    return [xxhash.xxh3_64_intdigest(raw[k * 8 * ROWS : (k + 1) * 8 * ROWS], k) - (1 << 63) for k in range(BANDS)]


def fingerprint(own: np.ndarray) -> bytes:
    """The SimHash of a set: a bit is set if more than half of the hashes, mixed anew for each 64 bits, have it."""
    masks, factors = MASKS[BANDS * ROWS :], FACTORS[BANDS * ROWS :]
    count = np.zeros(BITS, np.int64)
    for s in range(0, len(own), 255):  # lanes of a byte count to 255
        wide = (own[s : s + 255] ^ masks) * factors
        wide ^= wide >> np.uint64(29)
        wide *= FACTORS[0]
        wide ^= wide >> np.uint64(32)
        lanes_of = SPREAD[wide.view(np.uint8).reshape(BITS // 64, -1, 8)]
        count += lanes_of.sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(-1)
    return np.packbits(2 * count > len(own), bitorder="little").tobytes()


def radius(size: int) -> int:
    """Differing bits up to which sets may be 0.8 alike; small sets differ in more bits, as ties of their counts fall to one side."""
    return 210 if size >= 64 else 255


def sets(rows: DataFrame, words: int) -> DataFrame:
    """(id, fp, size, keys) of rows (id, text); fp is a digest of the set, zero for the empty one."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            fp, size, keys = [], [], []
            for t in raw_texts(batch.column(1)):
                own = shingle_set(t, words)
                fp.append(digest(own))
                size.append(len(own))
                keys.append(band_keys(own) if len(own) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64()), pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "fp", "size", "keys"])

    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, fp long, size int, keys array<long>")


def digest(own: np.ndarray) -> int:
    """Signed digest of a set, zero for the empty one."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) if len(own) else 0


def profiles(texts: DataFrame, words: int) -> DataFrame:
    """(fp, wide, own) of rows (text): the digest, the fingerprint and the set."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = raw_texts(batch.column(0))
            for s, e in steps(texts, TEXT_BYTES):
                own = [shingle_set(t, words) for t in texts[s:e]]
                fp, wide = pa.array(map(digest, own), pa.int64()), pa.array(map(fingerprint, own), pa.binary())
                yield pa.RecordBatch.from_arrays([fp, wide, pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["fp", "wide", "own"])

    return map_arrow(texts, run, "fp long, wide binary, own array<long>")


def planes_of(wide: np.ndarray) -> np.ndarray:
    """(BITS, words): bit p of every fingerprint, 64 fingerprints in a word; spare lanes are zero."""
    padded = np.zeros((-(-len(wide) // 64) * 64, BITS // 8), np.uint8)
    padded[: len(wide)] = wide
    return np.ascontiguousarray(np.packbits(np.unpackbits(padded, axis=1, bitorder="little").T, axis=1, bitorder="little")).view(np.uint64)


def near(size: np.ndarray, i: np.ndarray, j: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of places lie within the radius."""
    good = np.zeros(len(i), bool)
    small = np.minimum(size[i], size[j]) < 64
    for part, limit in ((small, radius(1)), (~small, radius(64))):
        at = np.flatnonzero(part)
        for s in range(0, len(at), STEP // 16):
            some = at[s : s + STEP // 16]
            left, right = planes_of(wide[i[some]]), planes_of(wide[j[some]])
            good[some[lanes(within(lambda p, w, x=left, y=right: x[p, w] ^ y[p, w], left.shape[1], limit, BITS), len(some))]] = True
    return good


def block_pairs(wide: np.ndarray, size: np.ndarray, root: np.ndarray, side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of one bucket (or of two blocks of it) within the radius, of other components and of sizes that can be alike."""
    planes = planes_of(wide)
    n, words = len(wide), planes.shape[1]
    full, zero = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
    a, b = [], []
    rows = max(1, STEP // 64 // words)
    for limit, chosen in ((radius(1), np.flatnonzero(size < 64)), (radius(64), np.flatnonzero(size >= 64))):
        for s in range(0, len(chosen), rows):
            q = chosen[s : s + rows]
            own = np.where(np.unpackbits(wide[q], axis=1, bitorder="little").T == 1, full, zero)
            hit = within(lambda p, at, own=own: planes[p, at % words] ^ own[p, at // words], len(q) * words, limit, BITS)
            bits = np.unpackbits(hit.view(np.uint8), bitorder="little").reshape(len(q), -1)[:, :n]
            i, j = np.nonzero(bits)
            i = q[i]
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            # A pair of sizes on both sides of 64 is taken from its smaller set.
            keep = (root[i] != root[j]) & (small >= least * large - 1e-9) & ((size[i] < size[j]) | ((size[i] == size[j]) & (i < j)))
            keep &= (side[i] == -1) | (side[i] != side[j])
            a.append(i[keep])
            b.append(j[keep])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def close_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b) of the rows (a, b, size, _size, wide, _wide) whose fingerprints lie within the radius."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            n = len(batch)
            wide = np.concatenate([np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, -1) for c in (4, 5)]) if n else np.zeros((0, BITS // 8), np.uint8)
            size = np.concatenate([batch.column(c).to_numpy() for c in (2, 3)])
            good = near(size, np.arange(n), np.arange(n, 2 * n), wide)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return map_arrow(pairs.select("a", "b", "size", "_size", "wide", "_wide"), run, "a long, b long")


def dealt_blocks(members: DataFrame, most: int) -> DataFrame:
    """(key, low, high, side, ...) of members (key, fp, size, ...): a row for each pair of blocks of its bucket that it takes part in.

    Blocks have about ``LIMIT`` members and sets of ``most`` hashes. A block meets itself with side -1 and each other block with the number of its own side.
    """
    parts = F.greatest(F.ceil(F.count("*") / LIMIT), F.ceil(F.sum("size") / most))
    n = members.groupBy("key").agg(parts.cast("int").alias("blocks"))
    placed = members.join(n, "key").withColumn("own_block", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int"))
    low, high = F.least("own_block", "other"), F.greatest("own_block", "other")
    side = F.when(F.col("own_block") == F.col("other"), -1).otherwise(F.col("own_block"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", low.alias("low"), high.alias("high"), side.alias("side"), *[c for c in members.columns if c != "key"])


def by_block(dealt: DataFrame, parse: Callable[[pa.RecordBatch], tuple], answer: Callable[[tuple, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``answer`` for whole pairs of blocks: columns as ``parse`` gives them for a batch, the number of each row's pair of blocks, and their counts."""

    def run(batches: Batches) -> Batches:
        held: list[tuple] = []  # of the last pair of blocks, which may go on in the next batch

        def out(rows: list[tuple]) -> pa.RecordBatch:
            group, *columns = (np.concatenate(c) for c in zip(*rows))
            starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1)]))
            return answer(tuple(columns), starts, np.diff([*starts, len(group)]))

        for batch in batches:
            if not len(batch):
                continue
            group = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (0, 1, 2)], axis=1)
            rows = (group, *parse(batch))
            differ = np.flatnonzero((group != group[-1]).any(axis=1))
            cut = int(differ[-1]) + 1 if len(differ) else 0
            if cut or (held and (held[-1][0][-1] != group[-1]).any()):
                yield out([*held, tuple(c[:cut] for c in rows)])
                held = []
            held.append(tuple(c[cut:] for c in rows))
        if held:
            yield out(held)

    by = ("key", "low", "high")
    return map_arrow(dealt.repartition(*by).sortWithinPartitions(*by), run, schema)


def fingerprints_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def paired(members: DataFrame, least: float) -> DataFrame:
    """(key, fp): the members (key, fp, size, root, wide) that have another one of their bucket, of another component, within the radius."""

    def parse(batch: pa.RecordBatch) -> tuple:
        return (*(batch.column(c).to_numpy() for c in (0, 3, 4, 5, 6)), fingerprints_of(batch.column(7)))

    def answer(columns: tuple, starts: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        key, side, fp, size, root, wide = columns
        number, hit = np.repeat(np.arange(len(starts)), counts), np.zeros(len(key), bool)
        few = np.flatnonzero(np.repeat(counts, counts) <= 16)
        for d in range(1, 16):  # places d apart of all small groups at once
            i, j = few[:-d], few[d:]
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            some = (number[i] == number[j]) & (root[i] != root[j]) & (small >= least * large - 1e-9) & ((side[i] == -1) | (side[i] != side[j]))
            i, j = i[some], j[some]
            good = near(size, i, j, wide)
            hit[i[good]] = hit[j[good]] = True
        for s, c in zip(starts[counts > 16], counts[counts > 16]):
            i, j = block_pairs(wide[s : s + c], size[s : s + c], root[s : s + c], side[s : s + c], least)
            hit[s + i] = hit[s + j] = True
        return pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(fp[hit])], names=["key", "fp"])

    dealt = dealt_blocks(members, 1 << 62).select("key", "low", "high", "side", "fp", "size", "root", "wide")
    return by_block(dealt, parse, answer, "key long, fp long").distinct()


def forest(own: list[np.ndarray], size: np.ndarray, root: np.ndarray, side: np.ndarray, wide: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """Places of a spanning forest of the links between the components of one bucket (or two blocks of it), by the sets of its members."""
    n, order = len(size), np.argsort(size, kind="stable")  # sets that can be alike stand together
    size, side, words = size[order], side[order], wide[order].view(np.uint64)
    component = np.unique(root[order], return_inverse=True)[1]
    hashes = np.unique(np.concatenate([own[k] for k in order]), return_inverse=True)[1]
    ends = np.cumsum(size)
    mark = np.zeros(int(hashes.max()) + 1, bool)
    a: list[int] = []
    b: list[int] = []
    for q in range(n):
        last = int(np.searchsorted(size, (size[q] + 1e-9) / least, "right"))
        j = np.arange(q + 1, last)
        j = j[(component[j] != component[q]) & ((side[q] == -1) | (side[j] != side[q]))]
        j = j[np.bitwise_count(words[j] ^ words[q]).sum(axis=1, dtype=np.int64) <= radius(int(size[q]))]
        if not len(j):
            continue
        mine = hashes[ends[q] - size[q] : ends[q]]
        mark[mine] = True
        both = np.add.reduceat(mark[hashes[ranges(size[j], ends[j] - size[j])]], np.cumsum(size[j]) - size[j], dtype=np.int64)
        mark[mine] = False
        j = j[both >= least * (size[q] + size[j] - both) - 1e-9]
        reached, at = np.unique(component[j], return_index=True)
        a += [int(order[q])] * len(at)
        b += order[j[at]].tolist()
        component[np.isin(component, reached)] = component[q]
    return a, b


def bucket_links(members: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(a, b): links between components inside the buckets of members (key, fp, size, root, wide); fewer for a pair of blocks than it has members."""

    def parse(batch: pa.RecordBatch) -> tuple:
        own, at = batch.column(8), np.empty(len(batch), object)
        values, ends = own.values.to_numpy(), own.offsets.to_numpy()
        at[:] = [values[s:e] for s, e in zip(ends[:-1], ends[1:])]
        return (*(batch.column(c).to_numpy() for c in (3, 4, 6)), np.array(list(map(len, at)), np.int64), fingerprints_of(batch.column(7)), at)

    def answer(columns: tuple, starts: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        side, fp, root, size, wide, own = columns
        a, b = [], []
        for s, c in zip(starts.tolist(), counts.tolist()):
            i, j = forest(own[s : s + c], size[s : s + c], root[s : s + c], side[s : s + c], wide[s : s + c], least) if c > 1 else ([], [])
            a += fp[s : s + c][i].tolist() if i else []
            b += fp[s : s + c][j].tolist() if j else []
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    some = stage(paired(members, least), "paired")
    sized = stage(members.join(some, ["key", "fp"]).select("key", "fp", "size", "root"), "sized")
    dealt = dealt_blocks(sized, HASHES).join(known, "fp").select("key", "low", "high", "side", "fp", "size", "root", "wide", "own")
    return stage(by_block(dealt, parse, answer, "a long, b long").distinct(), "alike")


def verified(pairs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets, the ``own`` of ``known``, have a Jaccard similarity of ``least`` or more."""
    x, y = (known.select(F.col("fp").alias(k), F.col("own").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    both = stage(pairs, "pairs").join(x, "a").join(y, "b").withColumn("n", F.size(F.array_intersect("x", "y")))
    return stage(both.where(F.col("n") >= F.lit(least) * (F.size("x") + F.size("y") - F.col("n")) - 1e-9).select("a", "b"), "alike")


def links(distinct: DataFrame, texts: Callable[[DataFrame], DataFrame], words: int, least: float) -> DataFrame:
    """(a, b): links between distinct sets (fp, size, keys) that hold their components together; ``texts`` gives (text), one for each row of a table of fp."""
    dealt = distinct.select("fp", "size", F.explode("keys").alias("key"))
    first = dealt.groupBy("key").agg(F.min(F.struct("fp", "size")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = stage(dealt.join(first, "key"), "shared")
    known = stage(profiles(texts(shared.select("fp").distinct()), words), "profiles")
    wide = known.select("fp", "wide")
    fits = F.least("size", "_size") >= F.greatest("size", "_size") * F.lit(least) - 1e-9
    star = shared.where(F.col("fp") != F.col("first.fp")).select(F.col("fp").alias("a"), F.col("first.fp").alias("b"), "size", F.col("first.size").alias("_size")).where(fits).distinct()
    star = star.join(wide.withColumnRenamed("fp", "a"), "a").join(wide.select(F.col("fp").alias("b"), F.col("wide").alias("_wide")), "b")
    found = verified(close_pairs(star), known, least)
    joined = shared.select("key", "fp", "size").join(components(found).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    joined = stage(joined, "joined")
    # Buckets of one component, and of a star that has already met all its members, have nothing left to compare.
    mixed = joined.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2").select("key")
    members = joined.join(mixed, "key", "left_semi").join(wide, "fp")
    return found.unionByName(bucket_links(members, known, least))


def numbered_rows(rows: DataFrame, wanted: DataFrame, row: str, inside: bool = True) -> DataFrame:
    """The rows whose number is in ``wanted``, or those whose number is not. They stay where they are: numbers go round as bitmaps, a bit for each row of ``rows``, as Spark numbers rows of a partition one by one."""
    place = F.col(row).bitwiseAND(F.lit(BITMAP - 1))
    bitmaps = wanted.groupBy(F.shiftright(row, 15).alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bitmap"))
    byte = F.conv(F.hex(F.substring("bitmap", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftleft", F.lit(1), place.bitwiseAND(F.lit(7)).cast("int"))
    found = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_whole"), F.col(row), F.shiftright(row, 15).alias("bucket"))
    found = found.join(F.broadcast(stage(bitmaps, "bitmaps")), "bucket", "left")
    return found.where((F.coalesce(byte.bitwiseAND(bit), F.lit(0)) != 0) == F.lit(inside)).select("_whole.*")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest key, and one only if that key is repeated."""
    row = "_row"
    while row in docs.columns:
        row = "_" + row
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    every = stage(sets(numbered.select(F.struct(F.col(key), F.col(row)).alias("id"), F.col(text).alias("text")), words), "sets")
    firsts = every.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.any_value("size").alias("size"), F.any_value("keys").alias("keys"))
    distinct = stage(firsts, "distinct")

    def texts(wanted: DataFrame) -> DataFrame:
        return numbered_rows(numbered.select(row, F.col(text).alias("text")), distinct.join(wanted, "fp").select(F.col(f"first.{row}").alias(row)), row).select("text")

    got = answered(every.select("id", "fp"), distinct.select("fp", "first", "n"), links(distinct, texts, words, least))
    gone = got.where(F.col(f"id.{row}") != F.col(f"component_id.{row}")).select(F.col(f"id.{row}").alias(row))
    return numbered_rows(numbered, gone, row, inside=False).drop(row)
