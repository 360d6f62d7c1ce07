"""Secret scans with corpus-wide ownership, in DataFrame functions only.

1. Patterns mark the base spans of every whole text (three kinds) and the candidate values: long tokens
   that mix letters and digits. Matches come from ``regexp_extract_all`` and their places from the lengths of
   the pieces between them. The narrow result is written once; texts stay behind unless they are asked for.
2. Candidate digests are aggregated over the corpus, first by owner and repository, then by digest: a hot
   digest shrinks to one row for each task before anything is shuffled.
3. A value that ``max_owners`` owners or fewer use looks live and becomes a span of kind ``live``; a value that
   more owners share is a copied example. Base spans stay whatever their ownership.

Null text counts as empty. A null owner or repository counts as one of its own. Repeated rows are kept,
each with its spans, and count once for their owner. Columns beside those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.session import stage

#: Base patterns in their order, with the part whose length counts and the least length (fixed values).
#: For ``access`` and ``hex`` the least length is in the pattern, which finds the same spans.
BASE = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0),
    ("hex", r"[0-9a-f]{16,}", 0),
)
LIVE = "live"
KINDS = (*(k for k, _, _ in BASE), LIVE)
#: Candidate values: long tokens; of these, the ones that hold a letter and a digit.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
GROUP = 64
MARK = "[SECRET]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step, zero: Column) -> Column:
    """For each place of an array, ``step`` folded over the values before it; in groups, so long arrays stay cheap."""

    def fold(part: Column) -> Column:
        return F.aggregate(part, zero, step)

    def part(g: Column) -> Column:
        return F.slice(values, g * GROUP + 1, F.lit(GROUP))

    n = F.size(values)
    numbers = F.sequence(F.lit(0), F.floor((n - 1) / GROUP).cast("int"))

    def within(base: Column, own: Column) -> Column:
        return F.transform(own, lambda _, i: step(base, fold(F.slice(own, F.lit(1), i))))

    def every(groups: Column) -> Column:
        return F.flatten(F.transform(numbers, lambda g: let(fold(F.slice(groups, F.lit(1), g)), lambda base: let(part(g), lambda own: within(base, own)))))

    return F.when(n > 0, let(F.transform(numbers, lambda g: fold(part(g))), every)).otherwise(F.array().cast("array<int>"))


def located(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """Adds ``name``: the matches of the pattern as array<struct<start, stop, value>>, in code points."""
    df = df.withColumn(name, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    some = F.size(name) > 0
    df = df.withColumn("_gap", F.when(some, F.transform(F.split(F.col(text), pattern, -1), lambda x: F.length(x))))
    df = df.withColumn("_len", F.transform(name, lambda x, i: F.element_at("_gap", i + 1) + F.length(x)))
    df = df.withColumn("_at", running(F.col("_len"), lambda a, b: a + b, F.lit(0)))
    spans = F.transform(name, lambda x, i: F.struct((F.element_at("_at", i + 1) + F.element_at("_gap", i + 1)).alias("start"), (F.element_at("_at", i + 1) + F.element_at("_len", i + 1)).alias("stop"), x.alias("value")))
    return df.withColumn(name, F.when(some, spans).otherwise(F.array().cast("array<struct<start:int,stop:int,value:string>>"))).drop("_gap", "_len", "_at")


def long_enough(found: Column, pattern: str, least: int) -> Column:
    return F.filter(found, lambda s: F.length(F.regexp_extract(s["value"], pattern, 2)) >= least)


def of_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))


def number_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def scanned(docs: DataFrame, text: str, owner: Column, repository: Column, carry: list[str]) -> DataFrame:
    """One narrow row for each document: its number, ``carry``, base spans and candidate digests; written once."""
    df = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_carry"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("_owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("_repo"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    base = []
    for k, (kind, pattern, least) in enumerate(BASE):
        df = located(df, "_text", pattern, f"_{kind}")
        found = F.col(f"_{kind}")
        if least:
            found = long_enough(found, pattern, least)
        base.append(of_kind(found, k))
    df = located(df, "_text", CANDIDATE, "_cand")
    mixed = F.filter("_cand", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    cand = F.transform(mixed, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.md5(s["value"]).alias("digest")))
    return stage(df.select("_row", "_carry", "_owner", "_repo", F.array_sort(F.concat(*base)).alias("_base"), cand.alias("_cand")), "secrets")


def live_spans(found: DataFrame, max_owners: int) -> DataFrame:
    """(_row, _live): spans of candidates that few owners use."""
    each = found.where(F.size("_cand") > 0).select("_row", "_owner", "_repo", F.explode("_cand").alias("c")).select("_row", "_owner", "_repo", "c.*")
    by_repo = each.groupBy("digest", "_owner", "_repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("digest", "_owner").agg(F.count("*").alias("repos"))
    use = by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    own = use.where(F.col("owners") <= max_owners).select("digest")
    kind = F.lit(len(BASE))
    return each.join(own, "digest").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", kind.alias("kind"), "stop"))).alias("_live"))


def written(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def all_spans(docs: DataFrame, text: str, owner: Column | None, repository: Column | None, max_owners: int, carry: list[str]) -> DataFrame:
    """(_carry, _base, _spans) of every row. Rows without candidates take no part in the join with live spans."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    found = scanned(docs, text, owner, repository, carry)
    some = F.size("_cand") > 0
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    joined = found.where(some).join(live_spans(found, max_owners), "_row", "left")
    return found.where(~some).select("_carry", "_base", F.col("_base").alias("_spans")).unionByName(
        joined.select("_carry", "_base", F.array_sort(F.concat("_base", F.coalesce("_live", none))).alias("_spans"))
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: Column | None = None, repository: Column | None = None, max_owners: int = 2) -> DataFrame:
    """Key, ``base`` and ``spans`` (arrays of start, kind number, stop) of every row.

    The owner is ``source`` unless given; the repository is the language section of a source.
    """
    got = all_spans(docs, text, owner, repository, max_owners, [key])
    return got.select(F.col(f"_carry.`{key}`").alias(key), F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars", owner: Column | None = None, repository: Column | None = None, max_owners: int = 2) -> DataFrame:
    """The documents with every span replaced by ``MARK`` (overlapping and touching spans by one); ``length`` follows the text."""
    found = all_spans(docs, text, owner, repository, max_owners, docs.columns)
    spans, body = F.col("_spans"), F.col(f"_carry.`{text}`")
    done = found.withColumn("_reach", running(F.transform(spans, lambda s: s["stop"]), lambda a, b: F.greatest(a, b), F.lit(0)))

    def piece(s: Column, i: Column) -> Column:
        """The text kept before a span, with a mark where it starts a new stretch."""
        reach = F.element_at("_reach", i + 1)
        return F.when((s["start"] > reach) | (i == 0), F.concat(F.substring(body, reach + 1, s["start"] - reach), F.lit(MARK))).otherwise(F.lit(""))

    kept = F.array_join(F.transform(spans, piece), "")
    tail = F.substring(body, F.array_max(F.transform(spans, lambda s: s["stop"])) + 1, F.length(body))
    some = F.size(spans) > 0
    done = done.withColumn("_text", F.when(some, F.concat(kept, tail)).otherwise(body))
    out = {c: F.col(f"_carry.`{c}`") for c in docs.columns}
    out[text] = F.col("_text")
    if length in out:
        out[length] = F.when(some, F.length("_text").cast(docs.schema[length].dataType)).otherwise(out[length])
    return done.select(*[v.alias(c) for c, v in out.items()])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents"))
    count = [number_of("base", k).alias(f"n_{kind}") for k, (kind, _, _) in enumerate(BASE)]
    return got.select("doc_id", *count, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _oracle_kind(number: int, kind: str, pattern: str, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
  {kind}_m AS (SELECT rid, unnest(regexp_extract_all(t, '{p}', 0)) AS v, unnest(list_transform(string_split_regex(t, '{p}')[:-2], lambda x: length(x))) AS g, generate_subscripts(regexp_extract_all(t, '{p}', 0), 1) AS i FROM d WHERE regexp_matches(t, '{p}')),
  {kind} AS (SELECT rid, {number} AS k, v, sum(g + length(v)) OVER w AS stop, sum(g + length(v)) OVER w - length(v) AS start FROM {kind}_m WINDOW w AS (PARTITION BY rid ORDER BY i) QUALIFY {keep})"""


def oracle() -> str:
    assign = BASE[0][1]
    parts = [
        _oracle_kind(0, "assign", assign, f"length(regexp_extract(v, '{assign.replace(chr(39), chr(39) * 2)}', 2)) >= {BASE[0][2]}"),
        _oracle_kind(1, "access", BASE[1][1], "true"),
        _oracle_kind(2, "hex", BASE[2][1], "true"),
        _oracle_kind(3, "cand", CANDIDATE, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')"),
    ]
    names = "['" + "','".join(KINDS) + "']"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),{','.join(parts)},
  own AS (SELECT v FROM cand JOIN d USING (rid) GROUP BY v HAVING count(DISTINCT coalesce(source, '')) <= 2),
  base AS (SELECT rid, k, start, stop FROM assign UNION ALL SELECT rid, k, start, stop FROM access UNION ALL SELECT rid, k, start, stop FROM hex),
  every AS (SELECT * FROM base UNION ALL SELECT rid, k, start, stop FROM cand WHERE v IN (SELECT v FROM own)),
  b AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
          string_agg({names}[k + 1] || ':' || start || ':' || stop, ',' ORDER BY start, k) AS s FROM base GROUP BY rid),
  e AS (SELECT rid, string_agg({names}[k + 1] || ':' || start || ':' || stop, ',' ORDER BY start, k) AS s FROM every GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(e.s, '') AS spans
FROM d LEFT JOIN b USING (rid) LEFT JOIN e USING (rid)"""
