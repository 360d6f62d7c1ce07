"""Near-duplicates of the pipeline against the exact similarity of all pairs."""

import random

import corpus_pipeline as cp
from tidemark.llm import alike as A

SF = "/root/testdata/sf0.001"


def plain_set(text, words=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def plain_kept(rows, least=0.8):
    rows = sorted(rows)
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {rows[k][0] for k in range(len(rows)) if root[k] == k}


def kept(spark, rows):
    return sorted(r.doc_id for r in cp.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), SF).collect())


def test_edited_copies_go(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(40):
        words = rng.choices(vocab, k=rng.randint(30, 400))
        rows.append((len(rows), " ".join(words)))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):  # similarities on both sides of 0.8
            rows.append((len(rows), " ".join(rng.choice(vocab) if rng.random() < share else w for w in words)))
    want = plain_kept(rows)
    assert 40 < len(want) < 200 and kept(spark, rows) == sorted(want)


def test_groups_joined_past_the_first_of_a_bucket(spark):
    words = [f"x{k}" for k in range(400)]
    rows = [(k, " ".join(words[12 * k : 12 * k + 200])) for k in range(12)]  # a chain: ends have little in common
    rows += [(100 + k, t) for k, t in enumerate([None, "", " \n", "one two", "One  two", "one two three"])]
    assert kept(spark, rows) == sorted(plain_kept(rows)) == [0, 100, 103, 105]


def test_given_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert kept(spark, rows) == sorted(plain_kept(rows))


def test_keys_and_fingerprints_of_a_pair_at_the_limit():
    rng = random.Random(5)
    for n, shared in ((900, 800), (9, 8), (5, 4), (70, 56), (90, 80)):
        missed = apart = 0
        for k in range(300):
            h = [rng.getrandbits(64) for _ in range(2 * n - shared)]
            small = h[:n] if 5 * shared >= 4 * (2 * n - shared) else h[:shared]  # otherwise a subset, at 0.8 as well
            a, b = (A.np.unique(A.np.array(x, A.np.uint64)) for x in (small, h[n - shared :] if small is not h[:shared] and len(small) == n else h[:n]))
            fx, fy = A.fingerprint(a), A.fingerprint(b)
            missed += not set(A.band_keys(a)) & set(A.band_keys(b))
            differ = int(A.np.bitwise_count(A.np.frombuffer(fx, A.np.uint64) ^ A.np.frombuffer(fy, A.np.uint64)).sum())
            apart += differ > A.radius(min(len(a), len(b)))
        assert missed == 0 and apart == 0


def test_shared_headers_move_no_sets(spark, monkeypatch):
    """400 texts with one header and words of their own: 79,800 pairs at about 0.5, none of them decided by its sets."""
    rng = random.Random(7)
    header = " ".join(f"h{k}" for k in range(120))
    rows = [(k, header + " " + " ".join(rng.choices([f"v{j}" for j in range(5000)], k=60))) for k in range(400)]
    rows += [(1000 + k, rows[3 * k][1] + f" end{k}") for k in range(20)]
    asked = []
    decide = A.verified

    def counted(pairs, *rest):
        pairs = A.stage(pairs, "counted")
        asked.append(pairs.count())
        return decide(pairs, *rest)

    monkeypatch.setattr(A, "verified", counted)
    for limit in (A.LIMIT, 50):  # in one block and in blocks of their own
        monkeypatch.setattr(A, "LIMIT", limit)
        asked.clear()
        assert kept(spark, rows) == list(range(400))
        assert 20 <= sum(asked) <= 60


def test_pairs_of_blocks():
    """Bit planes and carry-save counters against counted bits, over sizes on both sides of 64 and two blocks of a bucket."""
    rng = A.np.random.default_rng(4)
    centre = rng.integers(0, 256, (6, A.BITS // 8), A.np.uint8)
    wide = centre[rng.integers(0, 6, 300)] ^ A.np.packbits(rng.random((300, A.BITS)) < rng.uniform(0.02, 0.2, (300, 1)), axis=1)
    size, root = rng.integers(50, 90, 300), rng.integers(0, 250, 300)
    for side in (A.np.full(300, -1), rng.integers(0, 2, 300)):
        i, j = A.block_pairs(wide, size, root, side, 0.8)
        got = {(min(x, y), max(x, y)) for x, y in zip(i.tolist(), j.tolist())}
        want = set()
        for x in range(300):
            for y in range(x + 1, 300):
                s, t = sorted((size[x], size[y]))
                if root[x] != root[y] and s >= 0.8 * t and (side[x] == -1 or side[x] != side[y]):
                    if int(A.np.bitwise_count(wide[x] ^ wide[y]).sum()) <= A.radius(s):
                        want.add((x, y))
        assert len(i) == len(got) and got == want and want


def test_group_of_near_copies_makes_no_pairs(spark, monkeypatch):
    """900 short edits of one text on both sides of 0.8: no step has more rows than a set has bands, though most pairs lie within the radius."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(900):
        words = list(base)
        for at in rng.sample(range(60), 2):
            words[at] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    most, write = [], A.stage

    def counted(df, name, *rest):
        got = write(df, name, *rest)
        most.append((got.count(), name))
        return got

    monkeypatch.setattr(A, "stage", counted)
    assert kept(spark, rows) == sorted(plain_kept(rows))
    assert max(most)[0] <= A.BANDS * len(rows)


def test_forest_of_a_bucket():
    """Components by the sets alone, in one block and in two, joined up with the roots that are known."""
    rng = A.np.random.default_rng(6)
    pool = rng.integers(-(1 << 62), 1 << 62, 4000)
    own = [A.np.unique(A.np.concatenate([rng.permutation(pool[100 * g : 100 * g + 80])[:76], rng.choice(pool, 4)])) for g in rng.integers(0, 12, 150)]
    size = A.np.array(list(map(len, own)))
    at = A.np.empty(150, object)
    at[:] = own
    wide = A.np.stack([A.np.frombuffer(A.fingerprint(x.view(A.np.uint64)), A.np.uint8) for x in own])
    for root, side in ((A.np.arange(150), A.np.full(150, -1)), (rng.integers(0, 120, 150), A.np.full(150, -1)), (A.np.arange(150), A.np.arange(150) % 2)):

        def joined(pairs, root=root):
            label = root.tolist()
            for x, y in pairs:
                label = [label[x] if v == label[y] else v for v in label]
            return [label.index(v) for v in label]

        alike = [(x, y) for x in range(150) for y in range(x) if (side[x] == -1 or side[x] != side[y]) and (n := len(set(own[x].tolist()) & set(own[y].tolist()))) >= 0.8 * (size[x] + size[y] - n) - 1e-9]
        i, j = A.forest(at, size, root, side, wide, 0.8)
        assert set(map(tuple, map(sorted, zip(i, j)))) <= set(map(tuple, map(sorted, alike)))
        assert joined(zip(i, j)) == joined(alike) and 0 < len(i) < 150


def test_numbered_rows_stay_where_they_are(spark):
    rows = spark.range(0, 100_000, 1, 2).selectExpr("id as n").withColumn("r", A.F.monotonically_increasing_id())
    rows = A.stage(rows, "rows")
    wanted = rows.where("n % 7 = 3 or n in (0, 32767, 32768, 49999, 50000, 99999)").select("r")
    got, rest = A.numbered_rows(rows, wanted, "r"), A.numbered_rows(rows, wanted, "r", inside=False)
    assert got.columns == rest.columns == ["n", "r"] and rest.count() == 100_000 - got.count()
    assert rest.join(wanted, "r").count() == 0 and "Exchange hashpartitioning" not in rest._jdf.queryExecution().toString()
    assert sorted(x.n for x in got.collect()) == sorted({n for n in range(100_000) if n % 7 == 3} | {0, 32767, 32768, 49999, 50000, 99999})
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().toString() and A.numbered_rows(rows, wanted.limit(0), "r").count() == 0
