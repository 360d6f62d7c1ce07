"""Substring deduplication by hashing lines, and stretches of long lines.

A unit is a line, and in a longer line each stretch between content-defined anchors: words whose hash is the largest among
``REACH`` words on either side. Anchors depend on nearby words only, so a passage is cut in the same way wherever
it stands in a line. Units are normalised (lower case, letters and digits, single spaces) and hashed to 128 bits.
Digests are grouped over the corpus; the occurrence with the smallest (key, row, place) is kept, all others
are repeats. Repeated units that follow each other in a document form one span. A span that holds a whole repeated line goes
whatever its length; ``least_words`` words are asked of spans inside lines only. In scripts without spaces every letter is a word.
Spans keep their offsets in the original text.

Null and empty texts have no units; units without letters and digits join no run. Of repeated rows all but the
first lose their text. Digest groups are reduced before the shuffle and never collected; a frequent line
costs one row for each task.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, map_arrow, table
from tidemark.session import stage

REACH, LEAST_WORDS = 4, 20
#: Letters of scripts that do not part words (fixed ranges): Thai to Khmer, kana and ideographs, half-width kana.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f"
NO_SPACES, PARTED = re.compile(f"[{UNSPACED}]"), re.compile(r"\S+")
SPACED = re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")
PLAIN = re.compile(r"[\W_]+")


def anchors(h: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Whether a unit ends after each word: at the end of its line, or where its hash exceeds all nearby ones in the line."""
    n = len(h)
    at = np.arange(n) + line * REACH  # lines stand apart by REACH empty places
    wide = np.zeros(int(at[-1]) + 1 + 2 * REACH, np.int64)
    wide[at + REACH] = h
    own = wide[at + REACH]
    top = np.ones(n, bool)
    for d in range(1, REACH + 1):
        top &= (own > wide[at + REACH - d]) & (own > wide[at + REACH + d])
    top[:-1] |= line[1:] != line[:-1]
    top[-1] = True
    return top


def units(text: str, least: int = LEAST_WORDS) -> list[tuple[int, int, int, int, int, bytes]]:
    """(place, whole, start, stop, words, digest) of each unit, in order.

    ``place`` numbers the stretches; ``whole`` is 0 for a part of a line, 1 for a line of one stretch, and 2 for a line of several
    stretches, which stands for itself after the first of them. Lines of ``least`` words need no such row: if one is repeated, so
    are its stretches, which are long enough together.
    """
    spans = [m.span() for m in (SPACED if NO_SPACES.search(text) else PARTED).finditer(text)]
    if not spans:
        return []
    words = [PLAIN.sub("", text[a:b]).lower() for a, b in spans]
    crc = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
    breaks = np.array([m.start() for m in re.finditer("\n", text)], np.int64)
    line = np.searchsorted(breaks, np.array([a for a, _ in spans], np.int64))
    line = np.cumsum(np.concatenate([[0], np.diff(line) > 0]))  # without empty lines
    pair = np.zeros(len(words), np.int64)
    pair[1:] = np.where(line[1:] == line[:-1], crc[:-1], 0)
    mixed = ((pair * 0x9E3779B1 + crc * 0x85EBCA6B) & 0xFFFFFFFF) + 1
    ends = np.flatnonzero(anchors(mixed, line))
    starts = np.concatenate([[0], ends[:-1] + 1])
    end_of_line = np.concatenate([np.flatnonzero(line[1:] != line[:-1]), [len(line) - 1]])
    last_of = end_of_line[np.searchsorted(end_of_line, starts)]
    opens = np.concatenate([[True], line[starts[1:]] != line[starts[1:] - 1]])
    out = []

    def add(place: int, whole: int, first: int, last: int) -> None:
        own = " ".join(w for w in words[first : last + 1] if w)
        if own:
            # A line of several stretches repeats such lines only; then each of its stretches repeats as well.
            out.append((place, whole, spans[first][0], spans[last][1], last + 1 - first, xxhash.xxh3_128_digest(own.encode(), 1 if whole == 2 else 0)))

    for place, (first, last, final, opening) in enumerate(zip(starts.tolist(), ends.tolist(), last_of.tolist(), opens.tolist())):
        add(place, int(opening and last == final), first, last)
        if opening and last < final < first + least - 1:
            add(place, 2, first, final)
    return out


def unit_table(docs: DataFrame, key: str, text: str, row: str, least: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "row", "place", "whole", "start", "stop", "words", "h1", "h2"]

    def out(batch: pa.RecordBatch, held: list[tuple[int, tuple]]) -> pa.RecordBatch:
        at, some = pa.array([k for k, _ in held], pa.int64()), [u for _, u in held]
        digest = np.frombuffer(b"".join(u[5] for u in some), np.int64).reshape(-1, 2)
        numbers = [pa.array([u[c] for u in some], pa.int32()) for c in range(5)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *numbers, pa.array(digest[:, 0]), pa.array(digest[:, 1])], names=names)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            held: list[tuple[int, tuple]] = []
            for k, t in enumerate(batch.column(2)):
                held += [(k, u) for u in units(t.as_py() or "", least)]
                if len(held) > 1 << 16:
                    yield out(batch, held)
                    held = []
            yield out(batch, held)

    return map_arrow(docs.select(key, row, text), run, f"key {kind}, row long, place int, whole int, start int, stop int, words int, h1 long, h2 long")


def repeated_spans(numbered: DataFrame, key: str, text: str, row: str, least_words: int) -> DataFrame:
    """(key, row, start, stop, n_words, n_units, first_key) of every span to remove."""
    found = stage(unit_table(numbered, key, text, row, least_words), "units")
    rank = F.struct("key", "row", "place")
    groups = found.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    again = found.join(groups, ["h1", "h2"]).where(~rank.eqNullSafe(F.col("first")))
    part = F.col("whole") < 2  # a line of several stretches stands beside its first one, in the same run
    run = F.col("place") - F.count(F.when(part, 1)).over(Window.partitionBy("row").orderBy("place", "whole"))
    spans = again.withColumn("run", run).groupBy("row", "run").agg(
        F.first("key").alias("key"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum(F.when(part, F.col("words"))).alias("n_words"),
        F.count(F.when(part, 1)).alias("n_units"), F.min_by("first.key", F.struct("place", -F.col("whole"))).alias("first_key"), F.max("whole").alias("whole"),
    )
    return spans.where((F.col("whole") > 0) | (F.col("n_words") >= least_words)).drop("run", "whole")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    row = "_row"
    while row in docs.columns:
        row = "_" + row
    return docs.withColumn(row, F.monotonically_increasing_id()), row


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Key, first_<key> (where the earliest copy of the span's first unit stands, of its first line if that is repeated as a whole), start, stop, n_words, n_units of each span."""
    df, row = numbered(docs.select(key, text))
    got = repeated_spans(df, key, text, row, least_words)
    return got.select(F.col("key").alias(key), F.col("first_key").alias(f"first_{key}"), "start", "stop", "n_words", "n_units")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, which are sorted and apart; each goes with the white space after it."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        while b < len(text) and text[b].isspace():
            b += 1
        at = b
    return "".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """All columns of ``docs`` with the repeated spans cut from the text, and ``removed``: their offsets in the original."""
    df, row = numbered(docs)
    df = stage(df, "numbered")
    spans = repeated_spans(df, key, text, row, least_words).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("removed"))
    got = df.drop("removed").join(spans.withColumnRenamed("row", row), row, "left").drop(row)
    at = got.columns.index(text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in got.schema)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = [t if not r else without(t, [(s["start"], s["stop"]) for s in r]) for t, r in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return map_arrow(got, run, kinds)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents"))
