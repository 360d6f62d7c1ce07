"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

1. Patterns mark the base spans of every whole text (email, ip, card, phone). One more pattern finds occurrences: values of the four
   kinds and other tokens that may identify somebody (``digits`` or an at sign), each with the words around it. The narrow result is
   written once; texts stay behind.
2. Occurrences make a graph of lexical patterns (two words before; one before and one after) and values. Values of a base kind are seeds.
3. In each round a pattern is scored for a kind by the share of its distinct values that have that kind; ``values`` of them and a share of
   ``share`` make it confident. A value without a kind is scored by the mean over those of its patterns that ``values`` values share; from
   ``score`` on it takes the best kind (ties: the first listed) and is a seed of the next round. Scores are whole thousandths, so they do not depend on the order.
4. Occurrences of values that were found so become spans of kind ``context_`` and the kind, unless they touch a base span. Base spans stay.

Patterns and values shrink to distinct pairs in each task before anything is shuffled, so a frequent one costs no more than its
distinct partners. Null text counts as empty. Repeated rows are kept, each with its spans, and count once. Columns beside key and text
are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.secrets import running
from tidemark.session import stage

KINDS = ("email", "ip", "card", "phone")
NAMES = (*KINDS, *(f"context_{k}" for k in KINDS))
#: Patterns of the kinds (fixed values).
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: The same matches without going back and without a second look at a run of characters: a match starts where such a run or the search does.
STARTS = (r"(?:\G|(?<![A-Za-z0-9._%+-]))", r"(?:\G|(?<![0-9]))", "", "")
STEADY = (
    STARTS[0] + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    STARTS[1] + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9]++(?:[\x20-][0-9]++)*+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
ADDRESS = rf"^{PART}\.{PART}\.{PART}\.{PART}$"
#: An occurrence: a number like a phone's, groups of digits, or a token of identifier characters that begins and ends with a letter or digit.
OCCURRENCE = r"\+[0-9][\x20().0-9-]+[0-9]|[0-9]{2,6}(?:[\x20-][0-9]{2,6}){2,5}|[A-Za-z0-9+][A-Za-z0-9@._%+/#-]{4,}[A-Za-z0-9]"
SPACE, INK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
BEFORE, AFTER, REACH = rf"({INK}+){SPACE}+({INK}+){SPACE}*$", rf"^{SPACE}*({INK}+)", 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: int, value: Column) -> Column:
    n = F.length(digits(value))
    return [F.lit(True), value.rlike(ADDRESS), n.between(12, 19) & F.call_function("luhn_check", digits(value)), n.between(9, 15)][kind]


def marked(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """Adds ``name``: the matches as array<struct<start, stop, value, before, after>>, in code points; before and after end at the next match."""
    df = df.withColumn("_hit", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    some = F.size("_hit") > 0
    df = df.withColumn("_gap", F.when(some, F.split(F.col(text), pattern, -1)))
    df = df.withColumn("_len", F.transform("_hit", lambda x, i: F.length(F.element_at("_gap", i + 1)) + F.length(x)))
    df = df.withColumn("_stop", running(F.col("_len"), lambda a, b: a + b, F.lit(0)))

    def span(x: Column, i: Column) -> Column:
        stop = F.element_at("_stop", i + 1) + F.element_at("_len", i + 1)
        before, after = F.right(F.element_at("_gap", i + 1), F.lit(REACH)), F.left(F.element_at("_gap", i + 2), F.lit(REACH))
        return F.struct((stop - F.length(x)).alias("start"), stop.alias("stop"), x.alias("value"), before.alias("before"), after.alias("after"))

    none = F.array().cast("array<struct<start:int,stop:int,value:string,before:string,after:string>>")
    return df.withColumn(name, F.when(some, F.transform("_hit", span)).otherwise(none)).drop("_hit", "_gap", "_len", "_stop")


def base_spans(found: Column, kind: int) -> Column:
    """The matches of a kind that are valid, as array<struct<start, kind, stop>>."""
    good = F.filter(found, lambda s: valid(kind, s["value"]))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))


def number_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def kind_of(value: Column) -> Column:
    """Number of the base kind of a whole value, -1 for none."""
    out = F.lit(-1)
    for k in reversed(range(len(KINDS))):
        out = F.when(value.rlike(f"^{STEADY[k].removeprefix(STARTS[k])}$") & valid(k, value), k).otherwise(out)
    return out


def contexts(before: Column, after: Column) -> Column:
    """Lexical patterns of an occurrence; an empty array where words are missing."""
    before, after = (F.translate(c, UPPER, LOWER) for c in (before, after))
    far, close, following = F.regexp_extract(before, BEFORE, 1), F.regexp_extract(before, BEFORE, 2), F.regexp_extract(after, AFTER, 1)
    two = F.when(close != "", F.concat(F.lit("before "), far, F.lit(" "), close))
    around = F.when((close != "") & (following != ""), F.concat(F.lit("around "), close, F.lit(" "), following))
    return F.array_compact(F.array(two, around))


def scanned(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(_row, _key, _base, _seen): base spans and occurrences of each document; written once."""
    df = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    base = []
    for k, pattern in enumerate(STEADY):
        df = marked(df, "_text", pattern, f"_{KINDS[k]}")
        base.append(base_spans(F.col(f"_{KINDS[k]}"), k))
    df = marked(df, "_text", OCCURRENCE, "_any")
    named = F.filter("_any", lambda s: s["value"].contains("@") | (F.length(digits(s["value"])) >= least))
    seen = F.transform(
        named, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.md5(s["value"]).alias("digest"), kind_of(s["value"]).alias("kind"), contexts(s["before"], s["after"]).alias("patterns"))
    )
    return stage(df.select("_row", "_key", F.array_sort(F.concat(*base)).alias("_base"), seen.alias("_seen")), "personal")


def discovered(edges: DataFrame, values: int, share: int, score: int, rounds: int) -> DataFrame:
    """(digest, kind) of values without a base kind that confident patterns give one; ``edges`` are distinct (pattern, digest, kind)."""
    labels = edges.where("kind >= 0").select("digest", "kind").distinct()
    total = edges.groupBy("pattern").agg(F.count("*").alias("total")).where(F.col("total") >= values)
    unknown = edges.where("kind < 0").select("pattern", "digest").join(total.select("pattern"), "pattern")
    open_ = stage(unknown.join(unknown.groupBy("digest").agg(F.count("*").alias("degree")), "digest"), "open")
    links, new = edges.select("pattern", "digest"), None
    for _ in range(rounds):
        hits = links.join(labels, "digest").groupBy("pattern", "kind").agg(F.count("*").alias("hits")).where(F.col("hits") >= values)
        trust = hits.join(total, "pattern").withColumn("trust", F.expr("1000 * hits div total")).where(F.col("trust") >= share).select("pattern", "kind", "trust")
        scored = open_.join(trust, "pattern").groupBy("digest", "kind", "degree").agg(F.sum("trust").alias("sum"))
        scored = scored.withColumn("score", F.expr("sum div degree")).where(F.col("score") >= score)
        best = scored.groupBy("digest").agg(F.min(F.struct((-F.col("score")).alias("less"), "kind")).alias("best")).select("digest", F.col("best.kind").alias("kind"))
        fresh = stage(best if new is None else best.join(new, "digest", "left_anti"), "fresh")
        if not fresh.limit(1).count():
            break
        new = fresh if new is None else stage(new.unionByName(fresh), "new")
        labels = labels.unionByName(fresh)
    return new if new is not None else labels.limit(0)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 4, values: int = 3, share: int = 600, score: int = 300, rounds: int = 3) -> DataFrame:
    """Key, ``base`` and ``spans`` (arrays of start, kind number in ``NAMES``, stop) of every row."""
    found = scanned(docs, key, text, least)
    some = F.size("_seen") > 0
    seen = found.where(some).select("_row", F.explode("_seen").alias("s")).select("_row", "s.*")
    edges = stage(seen.select("digest", "kind", F.explode("patterns").alias("pattern")).distinct(), "edges")
    new = discovered(edges, values, share, score, rounds)
    spans = seen.where("kind < 0").drop("kind").join(new, "digest").groupBy("_row").agg(F.collect_list(F.struct("start", (F.col("kind") + len(KINDS)).alias("kind"), "stop")).alias("_new"))
    joined = found.where(some).select("_row", "_key", "_base").join(spans, "_row", "left")
    free = F.filter("_new", lambda s: ~F.exists("_base", lambda b: (b["start"] < s["stop"]) & (b["stop"] > s["start"])))
    every = F.when(F.col("_new").isNull(), F.col("_base")).otherwise(F.array_sort(F.concat("_base", free)))
    got = found.where(~some).select("_key", "_base", F.col("_base").alias("_spans")).unionByName(joined.select("_key", "_base", every.alias("_spans")))
    return got.select(F.col("_key").alias(key), F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents"))
    count = [number_of("base", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return got.select("doc_id", *count, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def oracle() -> str:
    """The query in SQL, its rounds written out."""
    names = "['" + "','".join(NAMES) + "']"
    plain = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(length({plain})), lambda i: CASE WHEN i % 2 = 0 THEN {plain}[length({plain}) - i]::INT ELSE [0,2,4,6,8,1,3,5,7,9][{plain}[length({plain}) - i]::INT + 1] END)) % 10 = 0"
    ok = ["true", f"regexp_matches(v, '{ADDRESS}')", f"length({plain}) BETWEEN 12 AND 19 AND {luhn}", f"length({plain}) BETWEEN 9 AND 15"]

    def located(name: str, pattern: str) -> str:
        return f"""
  {name}_m AS (SELECT rid, unnest(m) AS v, unnest(g[:-2]) AS g, unnest(g[2:]) AS a, generate_subscripts(m, 1) AS i
    FROM (SELECT rid, regexp_extract_all(t, '{pattern}', 0) AS m, string_split_regex(t, '{pattern}') AS g FROM d WHERE regexp_matches(t, '{pattern}'))),
  {name} AS (SELECT rid, v, g, a, sum(length(g) + length(v)) OVER w AS stop, sum(length(g) + length(v)) OVER w - length(v) AS start FROM {name}_m WINDOW w AS (PARTITION BY rid ORDER BY i))"""

    kind = " ".join(f"WHEN regexp_full_match(v, '{PATTERNS[k]}') AND {ok[k]} THEN {k}" for k in range(4))
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    rounds = ""
    for r in range(3):
        rounds += f""",
  hits{r} AS (SELECT p, kind, count(*) AS hits FROM edges JOIN label{r} USING (v) GROUP BY p, kind),
  trust{r} AS (SELECT p, kind, 1000 * hits // total AS m FROM hits{r} JOIN total USING (p) WHERE hits >= 3 AND 1000 * hits // total >= 600),
  fresh{r} AS (SELECT v, arg_min(kind, -score * 10 + kind) AS kind FROM (SELECT v, kind, sum(m)::BIGINT // degree AS score FROM edges JOIN trust{r} USING (p) JOIN degree USING (v)
    WHERE v NOT IN (SELECT v FROM label{r}) GROUP BY v, kind, degree) WHERE score >= 300 GROUP BY v),
  label{r + 1} AS (SELECT * FROM label{r} UNION ALL SELECT * FROM fresh{r})"""
    base = " UNION ALL ".join(f"SELECT rid, {k} AS k, start, stop FROM {KINDS[k]} WHERE {ok[k]}" for k in range(4))
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{KINDS[k]}" for k in range(4))
    joined = f"string_agg({names}[k + 1] || ':' || start || ':' || stop, ',' ORDER BY start, k)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),{','.join(located(KINDS[k], PATTERNS[k]) for k in range(4))},{located('seen', OCCURRENCE)},
  s AS (SELECT rid, start, stop, v, CASE {kind} ELSE -1 END AS kind, {lower.format(f'right(g, {REACH})')} AS before, {lower.format(f'left(a, {REACH})')} AS after FROM seen WHERE contains(v, '@') OR length({plain}) >= 4),
  near AS (SELECT v, kind, regexp_extract(before, '{BEFORE}', 1) AS w2, regexp_extract(before, '{BEFORE}', 2) AS w1, regexp_extract(after, '{AFTER}', 1) AS w0 FROM s),
  edges AS (SELECT 'before ' || w2 || ' ' || w1 AS p, v, kind FROM near WHERE w1 <> '' UNION SELECT 'around ' || w1 || ' ' || w0, v, kind FROM near WHERE w1 <> '' AND w0 <> ''),
  total AS (SELECT p, count(*) AS total FROM edges GROUP BY p), degree AS (SELECT v, count(*) AS degree FROM edges JOIN total USING (p) WHERE total >= 3 GROUP BY v),
  label0 AS (SELECT DISTINCT v, kind FROM (SELECT v, kind FROM edges WHERE kind >= 0)){rounds.replace('edges JOIN label', '(SELECT p, v FROM edges) JOIN label').replace('FROM edges JOIN trust', 'FROM (SELECT p, v FROM edges) JOIN trust')},
  base AS ({base}),
  extra AS (SELECT rid, l.kind + 4 AS k, start, stop FROM s JOIN label3 l USING (v) WHERE s.kind < 0 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = s.rid AND b.start < s.stop AND b.stop > s.start)),
  b AS (SELECT rid, {counts}, {joined} AS s FROM base GROUP BY rid),
  e AS (SELECT rid, {joined} AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in KINDS)}, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(e.s, '') AS spans
FROM d LEFT JOIN b USING (rid) LEFT JOIN e USING (rid)"""
