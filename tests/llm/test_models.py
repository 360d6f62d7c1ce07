"""Quality network, language model and rules: held-out accuracy, edge cases, plain versions."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.llm import bytecnn as B
from tidemark.llm import langid as L
from tidemark.llm import rules as R
from tidemark.llm.forest import IsolationForest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def net(corpus):
    docs, labels = corpus
    texts, y = B.training_rows(docs, labels, "doc_id", "text", "quality", 3000, 50_000)
    out = B.ByteNet().fit(texts, y)
    out.prepare()
    return out


def auc(score, y):
    rank = score.argsort().argsort()
    one, none = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - one * (one - 1) / 2) / (one * none)


def test_quality_of_held_out_rows(corpus, net):
    docs, labels = corpus
    p = docs.join(labels, "doc_id").toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in p.doc_id])
    score = net.scores([t.encode() for t in p.text])
    assert auc(score[held], p.quality.values[held]) > 0.95
    assert ((score >= 0.7) == (p.quality == 1))[held].mean() > 0.9


def test_training_rows_leave_the_fold_out(corpus):
    docs, labels = corpus
    known = docs.join(labels, "doc_id").collect()
    held = {r.text.encode() for r in known if zlib.crc32(str(r.doc_id).encode()) % 4 == 2} - {r.text.encode() for r in known if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    texts, _ = B.training_rows(docs, labels, "doc_id", "text", "quality", 3000, 50_000)
    assert texts and not held & set(texts)


def test_blocks_cover_the_whole_text(net):
    """A plain convolution over the padded text gives the same maxima, and the end of a long text matters."""
    text = ("ordinary words in a row, " * 400).encode()
    x = np.frombuffer(B.padded(text), np.uint8)
    wide = np.concatenate([x, np.zeros(B.WIDTH, np.uint8)])
    plain = sum((net.p["embed"] @ net.p["kernel"][j])[wide[j : j + len(x)]] for j in range(B.WIDTH))
    best, share = net.blocks(x)
    np.testing.assert_allclose(best, plain.reshape(-1, B.BLOCK, B.FILTERS).max(1), rtol=1e-4, atol=1e-4)
    slow = np.array([any(i >= lag + 7 and all(x[i - k] == x[i - k - lag] > 0 for k in range(8)) for lag in B.LAGS) for i in range(0, 600)])
    np.testing.assert_array_equal(B.repeats(x[:600]), slow)
    assert net.scores([text])[0] != net.scores([text + b" !! $$$ !! ### " * 40])[0]


def test_gradients(net):
    rng = np.random.default_rng(0)
    small = B.ByteNet(seed=1)
    small.p["head"][:] = rng.normal(size=len(small.p["head"]))
    texts, y = [b"some short text", b"another one!! " * 30, b""], np.array([1.0, 0.0, 1.0])

    def loss():
        small.prepare()
        s = np.clip(small.scores(texts), 1e-12, 1 - 1e-12)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    g = small.gradients(texts, y)
    for name, at in (("head", 3), ("bias", 2), ("offset", 0), ("kernel", (2, 1, 4)), ("embed", (ord("o"), 3))):
        old = small.p[name][at]
        small.p[name][at] = old + 1e-4
        up = loss()
        small.p[name][at] = old - 1e-4
        down = loss()
        small.p[name][at] = old
        assert (up - down) / 2e-4 == pytest.approx(g[name][at], abs=2e-3)


def test_quality_of_odd_tables(spark, odd, labels, monkeypatch):
    monkeypatch.setattr(B, "FIT_STEPS", 5)
    got = B.classify(odd, odd, labels.limit(0)).collect()
    assert len(got) == odd.count() and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {0}
    few = spark.createDataFrame([(4, 1), (6, 0), (6, 0), (None, 1), (9, None)], "doc_id long, quality int")
    scored = B.classify(odd, odd, few)
    assert scored.count() == odd.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    kept = B.keep_good(odd, odd, few, threshold=0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count() and kept.where("score = 'x'").count() == odd.count()
    assert B.classify(odd.limit(0), odd, few).count() == 0


def test_languages_of_held_out_rows(corpus):
    docs, _ = corpus
    p = L.identify(docs, docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in p.doc_id])
    right = p.lang_pred == p.lang
    assert right[held].mean() > 0.97 and right[held & p.accepted].mean() >= right[held].mean()
    assert p.score.between(0, 1).all()


def test_logits_of_pieces(corpus):
    docs, _ = corpus
    rows, langs = L.training_rows(docs, "doc_id", "text", "lang", 40)
    names = sorted(set(langs))
    m = L.LanguageModel(names).fit(rows, np.array([names.index(x) for x in langs]), steps=200).prepare()
    text = "some words that go on " * 30_000  # several pieces
    at, n = L.counts(text)
    np.testing.assert_allclose(m.logits([text])[0], (n / n.sum()) @ m.embed[at] @ m.weight + m.bias, rtol=1e-3, atol=1e-3)


def test_languages_of_odd_tables(odd):
    got = {r.doc_id: r for r in L.identify(odd, odd).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3))
    assert got[8].lang_pred in ("en", "fr") and 0 <= got[8].score <= 1
    assert L.identify(odd, odd).count() == odd.count() and L.identify(odd.limit(0), odd).count() == 0
    assert {r.lang_pred for r in L.identify(odd, odd.limit(0)).collect()} == {"und"}


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rules_against_a_plain_version(corpus):
    docs, labels = corpus
    got = R.apply_rules(docs, labels).toPandas().set_index("doc_id")
    for r in docs.collect():
        want = plain_statistics(r.text)
        assert tuple(int(got.at[r.doc_id, c]) for c in R.STATS) == want
        assert got.at[r.doc_id, "base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert not (got.base_failed & got.kept).any()
    known = got.join(labels.toPandas().set_index("doc_id"), how="inner")
    known = known[~known.base_failed]
    assert known[known.quality == 1].kept.mean() > 0.99 and known[known.quality == 0].kept.mean() < 0.1


def test_rules_of_odd_tables(spark, odd, labels):
    got = R.apply_rules(odd, labels.limit(0))
    assert got.count() == odd.count()
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in got.where("doc_id in (1, 2, 3)").collect())
    assert R.apply_rules(odd.limit(0), labels).count() == 0
    assert {r.kept for r in got.where("doc_id = 6").collect()} == {True}  # nothing is known against it
    text = "a b c d e f\nx\nx\n \n \na b c d e f " * 3
    assert R.statistics(text)[:5] == plain_statistics(text)


def test_rules_learn_from_all_labelled_rows(spark):
    """Good rows of another kind count, wherever they stand among more labelled rows than 4,000."""
    n = 5000
    late = F.row_number().over(Window.orderBy(F.xxhash64(F.col("doc_id").cast("string")))) > 4000
    rows = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("late", late).withColumn("quality", F.when((F.col("doc_id") % 10 == 0) & ~F.col("late"), 0).otherwise(1))
    symbols = F.when(F.col("quality") == 0, 300).when(F.col("late"), 60).otherwise(F.col("doc_id") % 4).cast("int")
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.concat(F.lit("w"), (k * 7919 + F.col("doc_id") * 31).cast("string"))), " ")
    docs = rows.select("doc_id", F.concat(words, F.lit(" "), F.repeat(F.lit("#"), symbols)).alias("text"))
    kept = R.apply_rules(docs, rows.select("doc_id", "quality")).join(rows, "doc_id").toPandas()
    assert kept[kept.late].kept.mean() > 0.95 and kept[(kept.quality == 1) & ~kept.late].kept.mean() > 0.95 and not kept[kept.quality == 0].kept.any()
    scores = np.round(np.random.default_rng(3).random(900), 2)
    good, bad = scores[:700] * 0.7, scores[700:]
    cut = R.calibrated(good, bad, 0.002)
    assert (good <= cut).mean() >= 0.998 and min((good > c).mean() + (bad <= c).mean() for c in scores if (good <= c).mean() >= 0.998) == (good > cut).mean() + (bad <= cut).mean()


def test_forest_finds_what_is_apart():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.1, (400, 2))
    f = IsolationForest(x, (np.array([-3.0, -3]), np.array([3.0, 3])), seed=2)
    far, near = f.scores(np.array([[2.5, 2.5], [-2.0, 2.0]])), f.scores(x)
    assert far.min() > np.quantile(near, 0.99)
    assert f.scores(x[:0]).shape == (0,) and R.calibrated(near, far, 0.01) < far.min()
