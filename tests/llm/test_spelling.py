"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import spelling as S

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_near(words):
    """Pairs one edit apart, by one deletion from either or both."""
    out, by = {w: set() for w in words}, {}
    for w in words:
        for i in range(len(w)):
            by.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    for w in words:
        for v in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))]:
            for other in by.get(v, ()):
                if one_edit(w, other):
                    out[w].add(other), out[other].add(w)
    return out


def plain_rows(count, ratio=10):
    near, form = plain_near(count), {}
    for w in count:
        best = min(near[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= ratio * count[w] else None
    rows = set()
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return rows


def plain_count(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                count[w] += 1
    return {w: n for w, n in count.items() if n >= 2}


def columns(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_index_of_a_shard():
    rng = random.Random(2)
    for letters, top in (("ab", 6), ("abcdé", 9)):
        words = sorted({"".join(rng.choices(letters, k=rng.randint(1, top))) for _ in range(300)})
        got = set(S.near_words(words, words, words))
        assert got == {(a, b) for a in words for b in words if one_edit(a, b)}
    own = ["abcdefg", "abcdxfg", "xbcdefg", "abcdefgh"]
    assert S.near_words(own, ["abcdefg"], []) == [("abcdefg", "abcdefgh"), ("abcdefg", "abcdxfg")]  # the first half stands, the edit is behind it
    assert S.near_words(own, [], ["abcdefg"]) == [("abcdefg", "xbcdefg")]
    assert S.near_words([], ["a"], ["a"]) == []


@pytest.mark.parametrize("shard", [S.SHARD, 60])
def test_variants_of_all_words(spark, monkeypatch, shard):
    monkeypatch.setattr(S, "SHARD", shard)
    rng = random.Random(4)
    count = {}
    for _ in range(120):
        w = "abc" * (rng.random() < 0.4) + "".join(rng.choices("abcdeéz", k=rng.randint(7, 10)))
        n = rng.choice([20000, 3000, 900])
        for _ in range(4):  # chains of variants, each rarer than the one before
            count.setdefault(w, n)
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abxy") + w[i + 1 :], w[:i] + rng.choice("abxy") + w[i:]])
            n = max(1, n // rng.choice([9, 10, 11]))
    got = columns(S.variants(spark.createDataFrame(list(count.items()), "word string, n long")))
    assert len(got) == len(count) and set(got) == plain_rows(count)
    assert any(r[1] and r[2] != r[1] for r in got)  # a root beyond the form


def test_query_against_all_words(spark, documents):
    count = plain_count([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    got = columns(S.op12_spelling(spark, SF))
    assert len(got) == len(count) and set(got) == plain_rows(count)


def test_odd_tables(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = {r.word: r.n for r in S.count_words(odd, letters=2, written=S.damaged).collect()}
    want = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            want[w] += len(w) >= 2
    assert got == {w: n for w, n in want.items() if n >= 2}
    assert S.variants(S.count_words(odd.limit(0))).count() == 0
    assert S.variants(S.count_words(odd, written=S.damaged)).count() == len(plain_count(rows))
