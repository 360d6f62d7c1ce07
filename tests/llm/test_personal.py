"""Personal data against Python's regular expressions, a plain bootstrap and the SQL twin."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from tidemark.llm import personal as P

SF = "/root/testdata/sf0.001"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return [True, all(int(x) <= 255 for x in v.split(".")) if kind == 1 else False, 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15][kind]


def plain_base(t):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(P.PATTERNS) for m in re.finditer(p, t or "", re.A) if plain_valid(k, m.group()))


def plain_seen(t):
    """(start, stop, value, kind, patterns) of the occurrences of one text."""
    t, hits = t or "", []
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    found = list(re.finditer(P.OCCURRENCE, t, re.A))
    for i, m in enumerate(found):
        v = m.group()
        if "@" not in v and len(re.sub("[^0-9]", "", v)) < 4:
            continue
        kind = next((k for k, p in enumerate(P.PATTERNS) if re.fullmatch(p, v, re.A) and plain_valid(k, v)), -1)
        before = lower(t[found[i - 1].end() if i else 0 : m.start()][-P.REACH :])
        after = lower(t[m.end() : found[i + 1].start() if i + 1 < len(found) else len(t)][: P.REACH])
        b, a = re.search(P.BEFORE, before), re.search(P.AFTER, after)
        patterns = ([f"before {b[1]} {b[2]}"] if b else []) + ([f"around {b[2]} {a[1]}"] if a and b else [])
        hits.append((m.start(), m.end(), v, kind, patterns))
    return hits


def plain_new(texts, values=3, share=600, score=300, rounds=3):
    members, kinds, degree = {}, {}, {}
    for t in texts:
        for _, _, v, kind, patterns in plain_seen(t):
            for p in patterns:
                members.setdefault(p, set()).add(v)
                degree.setdefault(v, set()).add(p)
                if kind >= 0:
                    kinds[v] = kind
    new = {}
    for _ in range(rounds):
        trust = {}
        for p, own in members.items():
            for k in range(4):
                hits = sum(kinds.get(v) == k for v in own)
                if hits >= values and 1000 * hits // len(own) >= share:
                    trust[p, k] = 1000 * hits // len(own)
        fresh = {}
        for v, ps in degree.items():
            if v not in kinds:
                ps = [p for p in ps if len(members[p]) >= values]
                scored = [(-(sum(trust.get((p, k), 0) for p in ps) // max(1, len(ps))), k) for k in range(4)]
                if -min(scored)[0] >= score:
                    fresh[v] = min(scored)[1]
        if not fresh:
            break
        kinds.update(fresh), new.update(fresh)
    return new


def plain_spans(t, new):
    base = plain_base(t)
    extra = [(s, 4 + new[v], e) for s, e, v, kind, _ in plain_seen(t) if kind < 0 and v in new and not any(b < e and z > s for b, _, z in base)]
    return sorted(base + extra)


def spans(rows):
    return [tuple(r) for r in rows]


def test_base_spans_of_noise(spark):
    rng = random.Random(6)
    pieces = ["a.b@c.d", "@", "x", "é", ".", "-", " ", "1", "255", "256", "+1 (5", "4111111111111111", "4111 1111 1111 1111", "+49 30 1234567", "10.0.0.1", "010.00300.0.1", "%", "_", "😀", "\n", "a@b", "9" * 13, "(", ")", "#"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(1500)] + [None, "", "1.2.3.4.5.6.7.8", "a@b.c_d@e.f", "+1234567890+12345678901", "٣.1.2.3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: spans(r.base) for r in P.scan(df).collect()}
    assert got == {i: plain_base(t) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 300


def test_patterns_find_unseen_values(spark):
    rng = random.Random(8)
    card = lambda: next(d for d in iter(lambda: "".join(rng.choices("0123456789", k=16)), "") if luhn(d))
    rows = [f"please ring me on +1 555 {rng.randint(1000000, 9999999)} after lunch" for _ in range(12)]
    rows += ["please ring me on 555-0199-221 after lunch", "the desk line 555-0134-887 is free"]
    for k in range(4):  # found by the first context, they make the second one trusted
        rows += [f"Please ring ME on 555-013{k}-887 after noon", f"the desk line 555-013{k}-887 is free"]
    rows += ["ask the desk line 555-0177-331 is best"]
    rows += [f"pay by card {card()} now" for _ in range(4)] + ["pay by card 1234567890123456 now"]
    rows += [f"order number {rng.randint(10**6, 10**7)} was sent" for _ in range(20)] + ["order number +1 555 1234567 was sent"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    new = plain_new(rows)
    assert new["555-0199-221"] == new["555-0133-887"] == new["555-0177-331"] == 3 and new["1234567890123456"] == 2 and not any(v.isdigit() and len(v) == 7 for v in new)
    got = {r.doc_id: spans(r.spans) for r in P.scan(df).collect()}
    assert got == {i: plain_spans(t, new) for i, t in enumerate(rows)}
    twice = {r.doc_id: spans(r.spans) for r in P.scan(df.unionByName(df)).collect()}
    assert twice == got  # repeated rows count once


def test_query_against_plain_version(spark, documents):
    rows = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    new = plain_new(rows.values())
    got = {r.doc_id: r.spans for r in P.op13_personal(spark, SF).collect()}
    want = {i: ",".join(f"{P.NAMES[k]}:{s}:{e}" for s, k, e in plain_spans(t, new)) for i, t in rows.items()}
    assert got == want


def test_sql_twin_with_new_values(spark, tmp_path):
    rng = random.Random(9)
    rows = [f"write to him at u{rng.randint(1, 10**6)}@mail.example.org or at {rng.choice(['a', 'b'])}" for _ in range(30)] + ["write to him at u77@localhost or at a", "x u77@localhost y"]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, P.op13_personal(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(P.oracle()).fetchall()) and any("context_email" in r[-1] for r in got)


def test_odd_tables(spark, odd):
    got = P.scan(odd.withColumns({"_text": F.lit("x"), "start": F.lit(1), "digest": F.lit("d")}))
    assert got.columns == ["doc_id", "base", "spans"] and got.count() == odd.count()
    assert P.scan(odd.limit(0)).count() == 0


def test_long_runs_of_one_kind_end(spark):
    texts = ["a" * 400_000, "1" * 400_000, "1." * 100_000, "a." * 100_000 + "@" + "b." * 100_000 + "c", "+1" + "(" * 200_000, "1 " * 100_000]
    got = {r.doc_id: spans(r.base) for r in P.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)).collect()}
    assert len(got[2]) == 25_000 and got[3] == [(0, 0, 400_002)] and not got[0] and not got[1] and not got[4] and not got[5]
