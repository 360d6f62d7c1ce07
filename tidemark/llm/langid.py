"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is read as bytes with A-Z in lower case and everything that is not a letter byte as a space; its subwords are all runs
of 3 and of 4 bytes, hashed into ``BUCKETS`` rows of an embedding table. The mean embedding of the whole
text goes through a linear softmax. Training takes a bounded sample of rows with a language, as hashed counts of
whole texts; a fifth of the sample is set aside to calibrate the softmax's temperature and the probability below which an
answer counts as rejected (``accepted`` is false; the best guess is still given).

Null texts and texts without a letter are ``und`` with score 0. If nothing can be learned all texts are
``und``. Texts of any length are read whole, a bounded number of bytes at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, first_by_hash, fold, map_arrow, table

BITS, DIM = 15, 16
BUCKETS = 1 << BITS
STEP = 256 << 10
#: Rows that the model is fitted on.
FIT_ROWS = 1500
#: Lower case for A-Z; other ASCII characters count as spaces (fixed values).
READ = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
LETTER = regex.compile(r"\p{L}")


def subwords(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the runs of 3 and of 4 bytes that begin at each place (the last 3 places have no full run)."""
    b = x.astype(np.uint32)
    three = b[:-2] | b[1:-1] << 8 | b[2:] << 16
    four = three[:-1] | b[3:] << 24
    shift = np.uint32(32 - BITS)
    return (three * np.uint32(0x9E3779B1)) >> shift, (four * np.uint32(0x85EBCA6B)) >> shift


def readable(text: str) -> bytes:
    """Bytes with two spaces around them, so that every text has subwords."""
    return b"  " + text.encode().translate(READ) + b"  "


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    three, four = subwords(np.frombuffer(readable(text), np.uint8))
    c = np.bincount(three, minlength=BUCKETS) + np.bincount(four, minlength=BUCKETS)
    at = np.flatnonzero(c)
    return at.astype(np.int32), c[at].astype(np.int32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class LanguageModel:
    def __init__(self, names: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.names = names
        self.embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
        self.weight = np.zeros((DIM, len(names)))
        self.bias = np.zeros(len(names))
        self.temperature, self.limit = 1.0, 0.0

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = 12_000, rate: float = 0.8, precision: float = 0.99, seed: int = 9) -> LanguageModel:
        """SGD, one text at a time; every fifth row is kept for calibration."""
        aside = np.arange(len(y)) % 5 == 4
        learn = np.flatnonzero(~aside) if aside.any() else np.arange(len(y))
        rng = np.random.default_rng(seed)
        epochs = max(1, round(steps / len(learn)))
        for e in range(epochs):
            lr = rate * (1 - e / epochs)
            for i in rng.permutation(learn):
                at, n = rows[i]
                share = n / n.sum()
                mean = share @ self.embed[at]
                g = softmax(mean @ self.weight + self.bias)
                g[y[i]] -= 1
                back = self.weight @ g
                self.weight -= lr * np.outer(mean, g)
                self.bias -= lr * 0.1 * g
                self.embed[at] -= (lr * DIM * share)[:, None] * back
        if aside.any():
            z = np.array([n / n.sum() @ self.embed[at] for at, n in (rows[i] for i in np.flatnonzero(aside))]) @ self.weight + self.bias
            self.calibrate(z, y[aside], precision)
        return self

    def calibrate(self, z: np.ndarray, y: np.ndarray, precision: float) -> None:
        """Temperature of least log loss; lowest limit above which answers are right with ``precision``."""
        grid = np.geomspace(0.25, 8, 41)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / self.temperature)
        order = np.argsort(-p.max(1))
        right = np.cumsum(p.argmax(1)[order] == y[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(right >= precision)
        self.limit = float(p.max(1)[order[good[-1]]]) if len(good) else 1.0

    def prepare(self) -> LanguageModel:
        """One table of each bucket's part of the logits: a mean of embeddings times a matrix is a mean of these."""
        self.table = np.ascontiguousarray((self.embed @ self.weight).astype(np.float32))
        return self

    def logits(self, texts: list[str]) -> np.ndarray:
        """Logits of each text; a long text is summed piece by piece."""
        out = np.zeros((len(texts), len(self.names)))
        for k, t in enumerate(texts):
            x = np.frombuffer(readable(t), np.uint8)
            total = np.zeros(len(self.names))
            for s in range(0, len(x) - 3, STEP):
                three, four = subwords(x[s : s + STEP + 3])
                last = s + STEP >= len(x) - 3
                total += self.table[three if last else three[:STEP]].sum(axis=0) + self.table[four].sum(axis=0)
            out[k] = total / (2 * len(x) - 5)
        return out + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.names else []
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if known:
            p = softmax(self.logits([texts[i] for i in known]) / self.temperature)
            for i, row in zip(known, p):
                names[i], score[i] = self.names[int(row.argmax())], row.max()
        return names, score


def training_rows(docs: DataFrame, key: str, text: str, lang: str, fit_rows: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """Hashed counts of whole texts of at most ``fit_rows`` rows with a language, outside the held-out fold (crc32 mod 5 of 0)."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(key, 5) != 0))
    chosen = first_by_hash(known.select(key, lang), key, fit_rows)
    rows = known.select(key, lang, text).join(F.broadcast(chosen.select(key).distinct()), key, "left_semi").select(key, lang, text)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [counts(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.list_(pa.int32())), batch.column(0)], names=["lang", "at", "n", "key"])

    kind = docs.schema[key].dataType.simpleString()
    got = map_arrow(rows, run, f"lang string, at array<int>, n array<int>, key {kind}").dropDuplicates(["key", "lang", "at", "n"]).toPandas().sort_values(["key", "lang"], kind="stable")
    return [(np.asarray(a), np.asarray(n)) for a, n in zip(got["at"], got["n"])], got["lang"].tolist()


def identify(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Key, lang_pred, score and accepted of every row."""
    rows, langs = training_rows(training, key, text, lang, fit_rows)
    names = sorted(set(langs))
    model = LanguageModel(names)
    if rows:
        model.fit(rows, np.array([names.index(x) for x in langs]))
    model.prepare()
    del model.embed
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        model = shared.value
        for batch in batches:
            names, score = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(score >= max(model.limit, 1e-9))], names=[key, "lang_pred", "score", "accepted"])

    return map_arrow(docs.select(key, text), run, f"`{key}` {kind}, lang_pred string, score double, accepted boolean")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, docs).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
