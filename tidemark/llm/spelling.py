"""Groups of spelling variants: words one edit apart, found by search schemes over a bidirectional FM-index.

1. Runs of letters are counted over the corpus in DataFrame functions, with partial counts before the shuffle.
2. Two words one edit apart agree on the first or on the second half of either one. A word is dealt by its possible halves, so that the
   words that share a half with a query lie in one shard. Shards hold about ``SHARD`` rows; a half that more words share is cut into parts,
   and its queries go to every part.
3. A shard builds the FM-index of its words, each after a delimiter, and of the words reversed. A search keeps the rank intervals of
   both: it matches one half exactly to one side, then goes on over the other half to the other side, where one letter may be
   inserted, deleted or replaced. The delimiter at the end stands for one word. Intervals branch over letters that occur there, never over words.
4. The form of a word is its most frequent near word if that is ``ratio`` times as frequent; roots follow the forms by pointer doubling.

Null text has no words; a null key counts as an empty one. Repeated rows count again. Ties take the smallest word in code-point order.
No words give no rows. Columns beside key and text are not read. Time grows with the length of a word, memory with the words of a shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import group_arrow, table
from tidemark.session import stage

#: Rows of a shard, queries that one step searches, ranks between two marks of the occurrence table.
SHARD, STEP, MARK = 20_000, 10_000, 64
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Ranks:
    """FM-index of one direction: circular text of delimiter and word, its suffix ranks and the counts before each rank."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, letters: int):
        n = len(codes) + len(lengths)
        starts = np.cumsum(lengths + 1) - lengths - 1
        text = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[starts] = False
        text[inner] = codes
        rank, step = text, 1
        while True:  # words differ, so all rotations do
            rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
            if int(rank.max()) == n - 1:
                break
            rank, step = rank * n + np.roll(rank, -step), 2 * step
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        before = text[place - 1]
        self.size, self.letters = n, letters
        self.word = np.searchsorted(starts, place, side="right") - 1
        self.base = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=letters))])
        rows = np.full((n // MARK + 1) * MARK, letters, np.int64)
        rows[:n] = before
        self.rows = rows.reshape(-1, MARK)
        each = np.bincount((np.arange(len(rows)) // MARK * (letters + 1) + rows), minlength=len(self.rows) * (letters + 1)).reshape(-1, letters + 1)[:, :letters]
        self.marks = np.cumsum(each, axis=0) - each

    def before(self, at: np.ndarray) -> np.ndarray:
        """(len(at), letters): how often each letter stands before the suffixes of smaller rank."""
        block = at // MARK
        seen = np.arange(MARK) < (at % MARK)[:, None]
        flat = (np.arange(len(at))[:, None] * self.letters + self.rows[block])[seen]
        return self.marks[block] + np.bincount(flat, minlength=len(at) * self.letters).reshape(-1, self.letters)

    def before_letter(self, letter: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at // MARK
        return self.marks[block, letter] + ((self.rows[block] == letter[:, None]) & (np.arange(MARK) < (at % MARK)[:, None])).sum(axis=1)


def half_search(left: Ranks, right: Ranks, codes: np.ndarray, start: np.ndarray, length: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word): words that begin with the first ``half`` letters of a query and are one edit away in the rest.

    ``left`` extends a match to the left, ``right`` to the right; the exact part keeps the intervals of both.
    """
    n = len(length)
    low, other, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, left.size)
    for k in range(int(half.max()) + 1 if n else 0):
        q = np.flatnonzero((k <= half) & (size > 0))
        letter = np.where(k < half[q], codes[np.maximum(start[q] + half[q] - 1 - k, 0)], 0)
        first = left.before(low[q])
        count = left.before(low[q] + size[q]) - first
        here = np.arange(len(q))
        other[q] += np.where(np.arange(left.letters) < letter[:, None], count, 0).sum(axis=1)
        low[q], size[q] = left.base[letter] + first[here, letter], count[here, letter]
    q = np.flatnonzero(size > 0)
    exact = (q, half[q], other[q], size[q])
    edited = tuple(np.zeros(0, np.int64) for _ in range(4))
    found: list[tuple[np.ndarray, np.ndarray]] = [(edited[0], edited[0])]
    while len(exact[0]) or len(edited[0]):
        more = []
        q, at, low, size = exact
        open_ = at < length[q]
        letter = np.where(open_, codes[np.minimum(start[q] + at, len(codes) - 1)], -1)
        first = right.before(low)
        count = right.before(low + size) - first
        row, c = np.nonzero(count)
        row, c = row[c > 0], c[c > 0]  # past the delimiter is no edit
        step_low, step_size = right.base[c] + first[row, c], count[row, c]
        same = c == letter[row]
        exact = (q[row[same]], at[row[same]] + 1, step_low[same], step_size[same])
        for move, chosen in ((0, ~same), (1, ~same & open_[row])):  # inserted, replaced
            more.append((q[row[chosen]], at[row[chosen]] + move, step_low[chosen], step_size[chosen]))
        more.append((q[open_], at[open_] + 1, low[open_], size[open_]))  # deleted
        q, at, low, size = edited
        letter = np.where(at < length[q], codes[np.minimum(start[q] + at, len(codes) - 1)], 0) if len(q) else q
        first = right.before_letter(letter, low)
        size = right.before_letter(letter, low + size) - first
        low = right.base[letter] + first
        ended = (size > 0) & (at == length[q])
        found.append((q[ended], right.word[low[ended]]))
        on = (size > 0) & ~ended
        more.append((q[on], at[on] + 1, low[on], size[on]))
        edited = tuple(np.concatenate(c) for c in zip(*more))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def coded(words: list[str], letters: dict[int, int] | np.ndarray, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letters of all words, one after the other, and the lengths."""
    flat = np.frombuffer("".join(w[::-1] if reverse else w for w in words).encode("utf-32-le"), np.uint32)
    return np.searchsorted(letters, flat) + 1, np.fromiter(map(len, words), np.int64, len(words))


def near_words(indexed: list[str], first: list[str], second: list[str]) -> list[tuple[str, str]]:
    """(query, word of the index) one edit apart; ``first`` are queries whose first half is exact, ``second`` those whose second half is."""
    if not indexed:
        return []
    letters = np.unique(np.frombuffer("".join([*indexed, *first, *second]).encode("utf-32-le"), np.uint32))
    forward, backward = (Ranks(*coded(indexed, letters, reverse), len(letters) + 1) for reverse in (False, True))
    out = set()
    for queries, reverse in ((first, False), (second, True)):
        for s in range(0, len(queries), STEP):
            some = queries[s : s + STEP]
            codes, length = coded(some, letters, reverse)
            sides = (backward, forward) if reverse else (forward, backward)
            half = length - length // 2 if reverse else length // 2
            q, w = half_search(*sides, codes, np.cumsum(length) - length, length, half)
            out |= {(some[i], indexed[j]) for i, j in zip(q.tolist(), w.tolist())}
    return sorted(out)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of different words (word, n) one edit apart."""
    m = F.length("word")

    def halves(size: Column) -> list[Column]:
        front = F.floor(size / 2).cast("int")
        return [F.concat(F.lit("<"), F.substring("word", F.lit(1), front)), F.concat(F.lit(">"), F.substring("word", m - (size - front) + 1, size - front))]

    own = halves(m)
    keys = F.array_distinct(F.array(*[k for size in (m - 1, m, m + 1) for k in halves(size)]))
    index = words.select("word", "n", F.explode(keys).alias("key"), F.lit(0).alias("ask"))
    asked = words.select("word", "n", F.posexplode(F.array(*own)).alias("side", "key")).select("word", "n", "key", (F.col("side") + 1).alias("ask"))
    rows = stage(index.unionByName(asked), "halves")
    parts = rows.where("ask = 0").groupBy("key").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts")).where("parts > 1")
    shards = max(1, -(-rows.count() // SHARD))
    parted = rows.join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    one = F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    parted = parted.withColumn("part", F.explode(F.when(F.col("ask") == 0, one).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    dealt = parted.select(F.pmod(F.xxhash64("key", "part"), F.lit(shards)).alias("shard"), "word", "n", "ask")

    def search(rows: pa.Table) -> pa.Table:
        count, asks = {}, ([], [])
        for word, n, ask in zip(*(rows.column(c).to_pylist() for c in ("word", "n", "ask"))):
            if ask:
                asks[ask - 1].append(word)
            else:
                count[word] = n
        pairs = near_words(sorted(count), *asks)
        return pa.table({"word": pa.array([a for a, _ in pairs], pa.string()), "near": pa.array([b for _, b in pairs], pa.string()), "near_n": pa.array([count[b] for _, b in pairs], pa.int64())})

    return group_arrow(dealt, "shard", search, "word string, near string, near_n long").distinct()


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form (word, form); frequencies grow along a chain, so every chain ends."""
    roots = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        beyond = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stage(roots.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = after.select("word", "root")
        if not after.where("moved").limit(1).count():
            return roots


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for distinct words with their frequency (word, n)."""
    words = stage(words.select("word", "n"), "words")
    near = near_pairs(words)
    best = stage(near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")), "near")
    own = words.join(best, "word", "left")
    good = -F.col("best.less") >= ratio * F.col("n")
    own = stage(own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")), "forms")
    roots = followed(own.where("form is not null"))
    return own.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = 7, times: int = 2, written=lambda key, word: word) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, as ``written`` gives them, of at least ``letters`` code points and ``times`` occurrences."""
    runs = F.filter(F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0)), lambda w: F.length(w) >= letters)
    each = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(runs).alias("word"))
    each = each.select(written(F.col("key"), F.translate("word", UPPER, LOWER)).alias("word"))
    return each.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def damaged(key: Column, word: Column) -> Column:
    """Every 31st occurrence loses a letter, as the contract of the query says."""
    h = F.crc32(F.concat(key, F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = variants(count_words(table(spark, sf_dir, "documents"), written=damaged))
    return got.select("word", "form", "root", "n", "n_near", "form_n")
