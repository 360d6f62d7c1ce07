"""Periodic runs against a search of all periods and all stretches."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import runs as R

SF = "/root/testdata/sf0.001"


def plain_runs(w, least=6, exponent=4):
    """By definition: for each period the maximal stretches of words that equal the word a period before; a stretch counts for its smallest period."""
    best = {}
    for p in range(1, len(w) // exponent + 1):
        i = p
        while i < len(w):
            if w[i] != w[i - p]:
                i += 1
                continue
            s = i - p
            while i < len(w) and w[i] == w[i - p]:
                i += 1
            if i - s >= max(least, exponent * p):
                best.setdefault((s, i - s), p)
    return sorted((s, n, p) for (s, n), p in best.items())


def plain_planted(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def plain_collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def plain_row(doc_id, text):
    w = plain_planted(doc_id, text)
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(plain_collapsed(w, runs)).hexdigest())


def words(rng):
    kind = rng.randrange(6)
    n = rng.randrange(0, 130)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return ["a"] * n
    if kind == 2:
        base = [rng.choice("abcd") for _ in range(rng.randrange(1, 12))]
        return (["x"] * rng.randrange(4) + base * rng.randrange(1, 14))[:200] + [rng.choice("abcd") for _ in range(rng.randrange(5))]
    if kind == 3:  # blocks of blocks
        return (["a"] * 5 + ["b"] * rng.randrange(1, 5)) * rng.randrange(1, 9) + ["a"] * rng.randrange(9)
    if kind == 4:
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randrange(8)):
            a, b = b, b + a
        return b
    return [rng.choice("abcdefgh") for _ in range(n)]


@pytest.mark.parametrize("chunk", [R.CHUNK, 40])
def test_runs_of_small_texts(monkeypatch, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(60):
        texts = [words(rng) for _ in range(20)]
        got = R.answers([" ".join(w).encode() for w in texts], 6, 4)
        for w, (runs, best, collapsed) in zip(texts, got):
            want = plain_runs(w)
            assert [tuple(r.values()) for r in runs] == want
            assert collapsed == plain_collapsed([x.encode() for x in w], want)
    assert [tuple(r.values()) for r in R.answers([b"a a b a a b"], 2, 2)[0][0]] == [(0, 2, 1), (0, 6, 3), (3, 2, 1)]


def test_grammar_agrees_like_a_walk():
    rng = np.random.default_rng(1)
    for n in (5, 60, 400):
        for top in (1, 2, 5):
            s = np.concatenate([[100], np.tile(rng.integers(0, top, max(1, n // 3)), 3), [101]])
            g = R.Grammar(s, 2)
            a, b = rng.integers(1, len(s) - 1, 300), rng.integers(1, len(s) - 1, 300)
            a, b = a[a != b], b[a != b]
            for forward, step in ((True, 1), (False, -1)):
                for x, y, got in zip(a, b, g.agree(a, b, forward)):
                    k = 0
                    while s[x + step * k] == s[y + step * k]:
                        k += 1
                    assert got == k


def test_query_against_the_definition(spark, documents):
    got = sorted(tuple(r) for r in R.op11_runs(spark, SF).collect())
    assert got == sorted(plain_row(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    assert sum(r[1] > 0 for r in got) >= len(got) // 20


def test_odd_tables(spark, odd):
    got = R.periodic_runs(R.planted(odd))
    assert got.columns == ["doc_id", "runs", "best", "collapsed"] and R.planted(odd).columns == odd.columns
    rows = got.collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = next(o.text for o in odd.collect() if o.doc_id == r.doc_id)
        w = plain_planted(r.doc_id, text) if r.doc_id not in (6, 7) else None
        if w is not None:
            assert [tuple(x) for x in r.runs] == plain_runs(w) and r.collapsed.encode() == plain_collapsed(w, plain_runs(w))
    assert R.periodic_runs(odd.limit(0)).count() == 0


def test_long_texts_end():
    one, two = b"a " * 300_000, b"the cat sat on a mat " * 50_000
    (runs, best, collapsed), (other, _, short) = R.answers([one, two], 6, 4)
    assert [tuple(r.values()) for r in runs] == [(0, 300_000, 1)] and collapsed == b"a"
    assert [tuple(r.values()) for r in other] == [(0, 300_000, 6)] and short == b"the cat sat on a mat"
