import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash as S
from tidemark.llm.components import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def clustered(n, seed=1):
    """Distinct fingerprints around few centres, so buckets are large and links chain."""
    rng = np.random.default_rng(seed)
    out = set()
    while len(out) < n:
        x = (0, 0x0123456789ABCDEF, 0xFFFFFFFFFFFFFFFF, int(rng.integers(0, 2**63)))[rng.integers(4)]
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            x ^= 1 << int(b)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_counters(radius):
    fp = np.array(clustered(300), np.uint64)
    q = int(fp[7])
    planes = S.planes_of(fp)
    got = S.lanes(S.within(lambda p, at: planes[p, at] ^ np.uint64(0xFFFFFFFFFFFFFFFF if q >> p & 1 else 0), planes.shape[1], radius), len(fp))
    assert got.tolist() == np.flatnonzero(np.bitwise_count(fp ^ np.uint64(q)) <= radius).tolist()


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_join_what_lies_within_the_radius(spark, radius):
    fps = clustered(400)
    want = plain_components(fps, radius)
    ids = [100 + 3 * i for i in range(len(fps))]
    found = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in zip(ids, fps)], "id long, fp long")
    got = {r.id: r.component_id for r in S.group_documents(found.repartition(5), radius).collect()}
    assert got == {i: ids[w] for i, w in zip(ids, want)}


def test_one_bucket_of_many_members():
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 1 << 16, 900).astype(np.uint64))  # all share 48 bits
    a, b = S.large_links(fp, 2)
    assert len(a) < len(fp)  # a forest, not pairs
    assert (np.bitwise_count(fp[a] ^ fp[b]) <= 2).all()
    want = plain_components([int(x) for x in fp], 2)
    assert len(fp) - len(a) == len(set(want))


def test_documents_against_brute_force(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = plain_components(fps, 2)
    ids = [r.doc_id for r in rows]
    smallest = {}
    for i, w in zip(ids, want):
        smallest[w] = min(i, smallest.get(w, i))
    got = {r.doc_id: r for r in S.near_duplicates(documents).collect()}
    assert len(got) == len(rows)
    for i, f, w in zip(ids, fps, want):
        assert got[i].fingerprint == f"{f:016x}" and got[i].component_id == smallest[w]


def test_odd_tables(spark, odd):
    got = S.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = {r.doc_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {1, 2, 3} and {r.component_id for r in got if r.doc_id in zero} == {1}
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4} and {r.component_id for r in got if r.doc_id in (6, 7)} == {6}
    assert S.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (None, 3), (2000, 1999), (1999, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").where(F.lit(True))).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[k] for k in range(1000, 1200)} == {1000} and got[2000] == got[1999] == 1999
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_copies_take_the_broadcast_way(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_ROWS", 3)
    monkeypatch.setattr(S, "HOT_KEYS", 10**9)
    rows = [(i, 5) for i in range(40)] + [(100, 4), (101, 4), (200, 0xFF << 40)]
    got = {r.id: r.component_id for r in S.group_documents(spark.createDataFrame(rows, "id long, fp long")).collect()}
    assert len(got) == 43 and {got[i] for i in (*range(40), 100, 101)} == {0} and got[200] == 200
