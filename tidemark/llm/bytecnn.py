"""Quality classifier: a byte-level convolutional network in numpy.

A text is read as bytes, in blocks of 128; a chunk is two neighbouring blocks, so chunks overlap by half and
cover the whole text. ``FILTERS`` learned filters over ``WIDTH`` embedded bytes run over every position and are
max-pooled in each chunk. One more channel marks bytes whose last 8 bytes stand ``lag`` bytes earlier
as well, for a lag of 2 to 24; its mean over a chunk is pooled with the filters. The means and maxima over all chunks go through a
logistic unit to one probability.

Null and empty texts are one block of zero bytes and get the score of that block. Texts of any length
are scored whole, a bounded number of bytes at a time. Repeated rows and null keys are kept. Without labelled rows of
both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, first_by_hash, fold, map_arrow, raw_texts, table

BLOCK, WIDTH, FILTERS, EMBED, RUN = 128, 6, 8, 8, 8
LAGS = range(2, 25)
STEP = 512 << 10
#: Labelled rows that the network is fitted on, and the longest text among them.
FIT_ROWS, FIT_CHARS = 3000, 50_000
#: Batches that training takes, however many rows there are.
FIT_STEPS = 1100


def padded(text: bytes) -> bytes:
    """The text with zero bytes up to whole blocks; filters never reach the next text."""
    pad = -len(text) % BLOCK
    return text + b"\0" * (pad if pad >= WIDTH - 1 and len(text) + pad else pad + BLOCK)


def repeats(x: np.ndarray) -> np.ndarray:
    """1 where the last ``RUN`` bytes equal those some lag earlier (zero bytes do not count)."""
    found = np.zeros(len(x), bool)
    for lag in LAGS:
        if len(x) <= lag + RUN:
            break
        same = (x[lag:] == x[:-lag]) & (x[lag:] > 0)
        for shift in (1, 2, 4):
            same = same[shift:] & same[:-shift]
        found[lag + RUN - 1 :] |= same
    return found


class ByteNet:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)), "kernel": rng.normal(0, 0.5, (WIDTH, EMBED, FILTERS)), "bias": np.zeros(FILTERS),
            "head": np.zeros(2 * FILTERS + 2), "offset": np.zeros(1),
        }
        self.p["embed"][0] = 0
        self.tables: list[np.ndarray] | None = None

    def prepare(self) -> None:
        """Tables of the filters' answers for two bytes at a time."""
        t = [(self.p["embed"] @ k).astype(np.float32) for k in self.p["kernel"]]
        self.tables = [(t[j + 1][:, None, :] + t[j][None, :, :]).reshape(-1, FILTERS) for j in range(0, WIDTH, 2)]

    def blocks(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best answer of each filter in each block, and the share of repeats in the block."""
        wide = np.concatenate([x, np.zeros(WIDTH, np.uint8)]).astype(np.int32)
        pair = wide[:-1] | wide[1:] << 8
        n = len(x)
        total = np.take(self.tables[0], pair[:n], axis=0)
        for j in range(1, WIDTH // 2):
            total += np.take(self.tables[j], pair[2 * j : 2 * j + n], axis=0)
        return total.reshape(-1, BLOCK, FILTERS).max(axis=1), repeats(x).reshape(-1, BLOCK).mean(axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        parts = [padded(t) for t in texts]
        best, share, size = [], [], np.array([len(p) // BLOCK for p in parts], np.int64)
        for x in pieces(parts):
            b, s = self.blocks(x)
            best.append(b)
            share.append(s)
        return self.combine(np.concatenate(best), np.concatenate(share), size)[0] if parts else np.zeros(0)

    def combine(self, best: np.ndarray, share: np.ndarray, size: np.ndarray):
        """Probabilities from the blocks of texts with ``size`` blocks each, and what training needs."""
        first = np.cumsum(size) - size
        follows = np.ones(len(best), bool)
        follows[first + size - 1] = False
        nxt = np.minimum(np.arange(len(best)) + 1, len(best) - 1)
        chunk_best = np.where(follows[:, None], np.maximum(best, best[nxt]), best)
        chunk_share = np.where(follows, (share + share[nxt]) / 2, share)
        chunk = follows | np.repeat(size == 1, size)  # of several blocks the last one opens no chunk
        act = np.tanh(chunk_best + self.p["bias"])
        count = np.maximum(size - 1, 1)
        mean = np.add.reduceat(act * chunk[:, None], first) / count[:, None]
        top = np.maximum.reduceat(np.where(chunk[:, None], act, -2), first)
        rest = np.column_stack([np.add.reduceat(chunk_share * chunk, first) / count, np.maximum.reduceat(np.where(chunk, chunk_share, 0), first)])
        v = np.concatenate([mean, top, rest], axis=1)
        z = v @ self.p["head"] + self.p["offset"]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))), v, act, chunk, first, count, nxt, follows

    def gradients(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        parts = [padded(t) for t in texts]
        x = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(p) // BLOCK for p in parts], np.int64)
        wide = np.concatenate([x, np.zeros(WIDTH, np.uint8)])
        t = [self.p["embed"] @ k for k in self.p["kernel"]]
        total = sum(t[j][wide[j : j + len(x)]] for j in range(WIDTH)).reshape(-1, BLOCK, FILTERS)
        where = total.argmax(axis=1)
        best = np.take_along_axis(total, where[:, None, :], axis=1)[:, 0]
        p, v, act, chunk, first, count, nxt, follows = self.combine(best, repeats(x).reshape(-1, BLOCK).mean(axis=1), size)
        dz = (p - y) / len(y)
        doc = np.repeat(np.arange(len(y)), size)
        dv = dz[:, None] * self.p["head"]
        dact = dv[doc, :FILTERS] / count[doc, None] * chunk[:, None]
        is_top = (act == v[doc, FILTERS : 2 * FILTERS]) & chunk[:, None]
        ties = np.add.reduceat(is_top, first, dtype=np.int64)
        dact += is_top * dv[doc, FILTERS : 2 * FILTERS] / np.maximum(ties[doc], 1)
        dbest = dact * (1 - act**2)
        from_next = follows[:, None] & (best[nxt] > best)
        own = np.where(from_next, 0, dbest)
        np.add.at(own, nxt[:, None].repeat(FILTERS, 1)[from_next], 0)
        rows, cols = np.nonzero(from_next)
        np.add.at(own, (nxt[rows], cols), dbest[rows, cols])
        at = np.arange(len(best))[:, None] * BLOCK + where
        g = {"bias": dbest.sum(0), "head": v.T @ dz, "offset": dz.sum(keepdims=True), "embed": np.zeros((256, EMBED)), "kernel": np.zeros_like(self.p["kernel"])}
        f = np.broadcast_to(np.arange(FILTERS), at.shape)
        for j in range(WIDTH):
            dt = np.bincount((wide[at + j].astype(np.int64) * FILTERS + f).ravel(), own.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            g["embed"] += dt @ self.p["kernel"][j].T
            g["kernel"][j] = self.p["embed"].T @ dt
        g["embed"][0] = 0
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int | None = None, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> ByteNet:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, epochs = 0, max(1, round((steps or FIT_STEPS) * batch / max(len(texts), batch)))
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), batch):
                take = order[k : k + batch]
                g = self.gradients([texts[i] for i in take], y[take])
                step += 1
                for name in self.p:
                    grad = g[name] + decay * self.p[name] * (name != "offset")
                    m[name] = 0.9 * m[name] + 0.1 * grad
                    s[name] = 0.99 * s[name] + 0.01 * grad**2
                    self.p[name] -= rate * (1 - 0.9 * epoch / epochs) * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-8)
        return self


def pieces(parts: list[bytes]) -> Iterator[np.ndarray]:
    """The padded texts in a row, in arrays of whole blocks of at most ``STEP`` bytes unless a text spans them.

    A long text is cut between blocks with the bytes that filters and lags look at kept within one piece
    by taking texts whole; only the memory of one text beyond ``STEP`` is added.
    """
    at, size = 0, 0
    for k, p in enumerate(parts):
        if size and size + len(p) > STEP:
            yield np.frombuffer(b"".join(parts[at:k]), np.uint8)
            at, size = k, 0
        size += len(p)
    if at < len(parts):
        yield np.frombuffer(b"".join(parts[at:]), np.uint8)


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, fit_rows: int, fit_chars: int) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most ``fit_rows`` labelled rows outside the held-out fold (crc32 mod 4 of 2)."""
    known = labels.select(key, label).where(F.col(label).isNotNull() & (fold(key, 4) != 2)).distinct()
    chosen = F.broadcast(first_by_hash(known, key, fit_rows))
    rows = docs.select(key, text).where(F.length(text) <= fit_chars).join(chosen, key).dropDuplicates([key, label]).orderBy(key, label).select(text, label).collect()
    return [r[0].encode() for r in rows], np.array([r[1] for r in rows], float)


def fitted(spark: SparkSession, training: DataFrame, labels: DataFrame, key: str, text: str, label: str, fit_rows: int, fit_chars: int):
    """The network, ready to score, as a broadcast of bounded size (1.5 MB of tables)."""
    texts, y = training_rows(training, labels, key, text, label, fit_rows, fit_chars)
    net = ByteNet()
    if len(set(y)) > 1:
        net.fit(texts, y)
    net.prepare()
    return spark.sparkContext.broadcast(net)


def classify(docs: DataFrame, training: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> DataFrame:
    """Key, ``score`` (0 to 1) and ``predicted`` (1 from the threshold on) of every row."""
    model = fitted(docs.sparkSession, training, labels, key, text, label, fit_rows, fit_chars)

    def run(batches: Batches) -> Batches:
        net = model.value
        for batch in batches:
            score = net.scores(raw_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[key, "score", "predicted"])

    return map_arrow(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, predicted int")


def keep_good(docs: DataFrame, training: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    model = fitted(docs.sparkSession, training, labels, key, text, label, fit_rows, fit_chars)
    at = docs.columns.index(text)

    def run(batches: Batches) -> Batches:
        net = model.value
        for batch in batches:
            yield batch.filter(pa.array(net.scores(raw_texts(batch.column(at))) >= threshold))

    return map_arrow(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = classify(docs, docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
