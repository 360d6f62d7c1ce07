"""Byte-level BPE with a pair occurrence index: encode whole texts, decode them again.

The new distinct words of a step (some MB of whole texts) are laid out as one array of symbols. An index maps each mergeable pair
(by its rank) to all its positions; ranks are taken in ascending order from a heap, every position of
the rank is merged at once, and the pairs that appear to the left and right of the merged symbols are
added to the lists of their ranks. A pair that holds a merged symbol always has a higher rank than the
merge that made the symbol (checked when the vocabulary is read), so no rank has to be taken twice.

Null and empty texts have no tokens and decode to the empty text. Texts of any length are encoded
whole. The vocabulary is read on the driver and broadcast (a few MB, fixed by the file).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import Batches, map_arrow, ranges, steps, table

#: Words of the byte-level pre-tokenizer (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHIFT = 20
#: Distinct words whose tokens a worker keeps between batches.
KEEP_WORDS = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairIndexBPE:
    def __init__(self, spec: str):
        model = json.loads(spec)
        if model.get("normalizer") is not None or model["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level vocabularies without normalizer and prefix space are supported")
        alphabet, vocab = byte_alphabet(), model["model"]["vocab"]
        self.added = {a["content"]: a["id"] for a in model["added_tokens"]}
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in model["added_tokens"]):
            raise ValueError("added tokens with stripping are not supported")
        names = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        names |= {i: t.encode() for t, i in self.added.items()}
        self.token_bytes = [names.get(i, b"") for i in range(max(names) + 1)]
        self.first = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        born = np.full(len(self.token_bytes), -1, np.int64)
        born[self.made[::-1]] = np.arange(len(merges))[::-1]
        if (np.maximum(born[self.left], born[self.right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge uses a symbol that a later merge makes")
        key = self.left << SHIFT | self.right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank_of = key[order], order
        self.words = regex.compile(WORDS)
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair has no merge."""
        key = a << SHIFT | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row, and the number of ids of each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        ends = np.cumsum(size)
        nxt = np.arange(1, n + 1)
        nxt[ends - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[ends - size] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Add the pairs that begin at these positions to the lists of their ranks."""
            rank = self.ranks(sym[at], sym[nxt[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *cut.tolist(), len(at)]
            for s, e in zip(bounds, bounds[1:]):
                r = int(rank[s])
                if r not in index:
                    heapq.heappush(active, r)
                index[r].append(at[s:e])

        enter(np.flatnonzero(nxt >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            a, b = self.left[r], self.right[r]
            at = np.unique(np.concatenate(lists))
            after = nxt[at]
            good = alive[at] & (sym[at] == a) & (after >= 0)
            good &= sym[after] == b
            at = at[good]
            if not len(at):
                continue
            after = nxt[at]
            if a == b:  # of a run of equal symbols every second position is a pair, from the left
                opens = np.ones(len(at), bool)
                opens[1:] = after[:-1] != at[1:]
                run = np.flatnonzero(opens)
                place = np.arange(len(at)) - np.repeat(run, np.diff([*run, len(at)]))
                at, after = at[place % 2 == 0], after[place % 2 == 0]
            sym[at] = self.made[r]
            alive[after] = False
            beyond = nxt[after]
            nxt[at] = beyond
            prv[beyond[beyond >= 0]] = at[beyond >= 0]
            enter(np.concatenate([prv[at][prv[at] >= 0], at[beyond >= 0]]))
        counts = np.add.reduceat(alive, ends - size, dtype=np.int64) if n else np.zeros(0, np.int64)
        return sym[alive], counts

    def split(self, text: str) -> list[tuple[str, int]]:
        """Pieces of the text with -1, and added tokens with their id."""
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += [(text[at : m.start()], -1), (m[0], self.added[m[0]])]
            at = m.end()
        return [*out, (text[at:], -1)]


class WordTable:
    """Tokens of the words seen so far by one worker."""

    def __init__(self, bpe: PairIndexBPE):
        self.bpe = bpe
        self.clear()

    def clear(self) -> None:
        self.slot: defaultdict[str, int] = defaultdict()
        self.slot.default_factory = self.slot.__len__
        self.ids = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def slots(self, text: str) -> np.ndarray:
        """The text as places in the table; -1 - id stands for an added token."""
        take, find = self.slot.__getitem__, self.bpe.words.findall
        parts = [[(-1 - i)] if i >= 0 else map(take, find(piece)) for piece, i in self.bpe.split(text)] if "<|" in text else [map(take, find(text))]
        return np.fromiter(chain.from_iterable(parts), np.int64)

    def fill(self) -> None:
        """Encode the words that have come since the last time."""
        if len(new := list(self.slot)[len(self.count) :]):
            ids, count = self.bpe.encode_words([w.encode() for w in new])
            self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, count])
        self.start = np.cumsum(self.count) - self.count

    def tokens(self, slots: np.ndarray) -> np.ndarray:
        word = slots >= 0
        at = np.where(word, slots, 0)
        if not len(self.count):
            return -1 - slots
        lengths = np.where(word, self.count[at], 1)
        out = self.ids[np.minimum(ranges(lengths, np.where(word, self.start[at], 0)), len(self.ids) - 1)]
        if not word.all():
            out[(np.cumsum(lengths) - lengths)[~word]] = -1 - slots[~word]
        return out


_LOADED: dict[str, PairIndexBPE] = {}


def loaded(spec: str) -> PairIndexBPE:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = PairIndexBPE(spec)
    return _LOADED[key]


def decode(token_bytes: list[bytes], ids: list[int]) -> str:
    return b"".join(map(token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Key, n_tokens, ids (unless ``with_ids`` is off), ids_sha256, decoded_sha256 of every row.

    Null text counts as empty; keys are carried as they are, null or repeated. No shuffle.
    """
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"

    def run(batches: Batches) -> Batches:
        bpe = loaded(spec.value)
        words = WordTable(bpe)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids_list, id_sha, text_sha = [], [], [], []
            for first, end in steps(texts):
                if len(words.slot) > KEEP_WORDS:
                    words.clear()
                slots = [words.slots(t) for t in texts[first:end]]
                words.fill()
                for s in slots:
                    ids = words.tokens(s)
                    packed = ids.astype("<i4")
                    n.append(len(ids))
                    id_sha.append(hashlib.sha256(packed).hexdigest())
                    text_sha.append(hashlib.sha256(decode(bpe.token_bytes, ids.tolist()).encode()).hexdigest())
                    if with_ids:
                        ids_list.append(packed)
            out = [batch.column(0), pa.array(n, pa.int64())]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids_list, np.zeros(0, "<i4")]))))
            out += [pa.array(id_sha), pa.array(text_sha)]
            yield pa.RecordBatch.from_arrays(out, names=[key, "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(key, text), run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), with_ids=False)
