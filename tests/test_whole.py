"""Registered queries over whole tables, against brute force on the smallest ones."""

import random
import re
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from fieldproof.operators import holding, improve
from fieldproof.plans import adapters as A
from fieldproof.plans import queries

DIR = "/root/testdata/sf0.001"
MISSING = {"", "—", "not disclosed", "unknown"}


def missing(v):
    return (v or "").strip().lower() in MISSING


def alnum(v):
    return re.sub("[^a-z0-9]", "", (v or "").lower())


@pytest.mark.parametrize(("meet", "block"), [(64, 1 << 19), (0, 40), (1, 8)])
def test_first_holding(spark, monkeypatch, meet, block):
    """By rare parts, by the automaton alone, and by both, in one block and in many."""
    monkeypatch.setattr(holding, "MEET", meet)
    monkeypatch.setattr(holding, "PATTERNS", block)
    monkeypatch.setattr(holding, "HOLDERS", 3 * block)
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice("abç") for _ in range(n))
    texts, wheres = ["", *(say(rng.randint(1, 9)) for _ in range(60)), None], ["", *(say(rng.randint(1, 40)) for _ in range(40)), None]
    runs = {"R": (texts, wheres), "S": (["aaa", "b"], ["aaab", "b", "aaab"]), "T": (["x"], []), None: (["a"], ["a"])}
    ranked = lambda xs: [(x, (rng.choice([None, *range(9)]), f"u{i}")) for i, x in enumerate(xs)]
    sides = {run: (ranked(t), ranked(w)) for run, (t, w) in runs.items()}
    rows = lambda n, c: spark.createDataFrame([(run, x, r) for run, s in sides.items() for x, r in s[n]], f"run_id string, {c} string, r struct<k:int,u:string>")
    a, b = rows(0, "text"), rows(1, "holder")
    least = lambda rs: min(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), default=None)
    first = {(run, x): least(r for y, r in w if y is not None and x in y) for run, (t, w) in sides.items() if run for x, _ in t if x is not None}
    held = {(run, y): least(r for x, r in t if x is not None and x in y) for run, (t, w) in sides.items() if run for y, _ in w if y is not None}
    known = lambda got: {(r.run_id, r[1]): tuple(r.r) for r in got if r.run_id}
    assert known(holding.first_holding(a.drop("r"), b).collect()) == {k: r for k, r in first.items() if r}
    assert known(holding.first_held(a, b.drop("r")).collect()) == {k: r for k, r in held.items() if r}
    pairs = {(r.run_id, r.text, r.holder) for r in holding.all_holding(a.drop("r"), b.drop("r")).collect() if r.run_id}
    assert pairs == {(run, x, y) for run, (t, w) in sides.items() if run for x, _ in t for y, _ in w if x and y is not None and x in y}


def test_one_short_value_in_many_holders(spark):
    """A hundred thousand holders of one value make few rows on the way, not one for each."""
    wheres = spark.range(100_000).select(F.lit("R").alias("run_id"), F.concat(F.lit("room 5 of house "), F.col("id").cast("string")).alias("holder"), F.struct(F.col("id").alias("k")).alias("r"))
    texts = spark.createDataFrame([("R", "5"), ("R", "house 777"), ("R", "nowhere"), ("R", " house ")], "run_id string, text string")
    got = {r.text: r.r.k for r in holding.first_holding(texts, wheres).collect()}
    assert got == {"5": 0, "house 777": 777, " house ": 0}
    need, have = holding._distinct(texts, wheres, "r")
    assert holding._scanned(need.where("length(text) < 5"), have, "text").count() <= 2


def test_backfill_reads_gaps_of_a_large_catalog(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 5)))
    catalog = [(i, rng.choice([word(), f"{word()} {word()}", f"{word()} X{i}"])) for i in range(300)] + [(5, "twice"), (400, None), (401, " ")]
    records = [(f"R{k % 40}", f"{word()} {word()}") for k in range(150)] + [("full", f"n{k}") for k in range(9)] + [("R1", None), ("R2", "")]
    alike = lambda a, b: bool(a and b) and (a in b or b in a)
    entries = sorted((p, n.strip().lower(), n) for p, n in catalog if n and n.strip())
    kept = [e for i, e in enumerate(entries) if not any(alike(e[1], o[1]) for o in entries[:i])]
    want = set()
    for run in {r for r, _ in records}:
        names = [(n or "").strip().lower() for r, n in records if r == run]
        seen = {s for n in names if n for s in (n, n.split(" ")[0])}
        free = [e for e in kept if not any(alike(e[1], s) for s in seen)]
        want |= {(run, p, n) for p, _, n in free[: max(0, 7 - len(names))]}
    got = improve.backfill(spark.createDataFrame(records, "run_id string, entity_name string"), spark.createDataFrame(catalog, "position int, entity_name string"), 7)
    assert sorted((r.run_id, r.position, r.entity_name) for r in got.collect()) == sorted(want)


def test_complete_evidence_reads_all_records_and_sources(spark):
    cited = {(r.record_id, r.field.lower()) for r in A.evidence(spark, DIR).where("verification = 'Confirmed'").collect()}
    parts = {r.p_partkey: r.p_name for r in A.table(spark, DIR, "part").collect()}
    run = lambda k: f"RUN-{k % 3 + 1}"
    sources = sorted((r.s_suppkey, f"https://s.example.com/{r.s_suppkey}", r.s_name, f"About {parts[7 * r.s_suppkey]} in Bangalore") for r in A.table(spark, DIR, "supplier").collect() if 7 * r.s_suppkey in parts)
    want = set()
    for r in A.fields(spark, DIR).collect():
        if missing(r.value) or (r.record_id, r.field.lower()) in cited:
            continue
        for k, url, title, snippet in sources:
            if run(k // 2) != r.run_id:
                continue
            if r.value.lower() in snippet.lower() or r.entity_name.lower() in snippet.lower() or r.entity_name.lower() in title.lower():
                want.add((r.record_id, r.field, r.value, title, url, snippet))
                break
    got = [tuple(r) for r in queries.complete_evidence(spark, DIR).collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(r[0] % 20 for r in got)


def test_enrich_gives_to_the_first_record_of_all(spark):
    rec = [(r.ingest_seq, r.record_id, alnum(r.entity_name), r.run_id) for r in A.records(spark, DIR).collect()]
    open_ = {r.record_id for r in A.fields(spark, DIR, ["Salary"]).collect() if missing(r.value)}
    best = {}
    for r in queries._found_later(spark, DIR).collect():
        k = alnum(r.entity_name)
        if missing(r.value) or r.value.lower() == "n/a" or not k:
            continue
        mine = [x for x in rec if x[3] == r.run_id]
        near = [x for x in mine if x[2] == k] or [x for x in mine if x[2] and (x[2] in k or k in x[2])]
        if near:
            owner = min(near)[1]
            v = (r.value, r.url is not None, r.url)
            best[owner] = min(best.get(owner, v), v)
    want = {(i, "Salary", v[0], v[2], "Confirmed" if v[2] else "Needs verification") for i, v in best.items() if i in open_}
    got = [tuple(r) for r in queries.enrich(spark, DIR).collect()]
    assert len(got) == len(want) and set(got) == want


def test_new_candidates_knows_all_records(spark):
    rec = [(r.run_id, r.record_id, r.entity_name) for r in A.records(spark, DIR).collect()]
    one = min(n for _, _, n in rec)
    got = [tuple(r) for r in queries.new_candidates(spark, DIR).select("run_id", "record_id", "entity_name").collect()]
    assert set(rec) <= set(got)
    known = {(run, n.strip().lower()) for run, _, n in rec} - {("RUN-1", ""), ("RUN-2", ""), ("RUN-3", "")}
    offered = [(f"RUN-{c.c_custkey % 3 + 1}", {0: "small ring", 1: "", 2: one}.get(c.c_custkey % 4, c.c_name).strip().lower()) for c in A.table(spark, DIR, "customer").collect()]
    assert sorted((run, n.strip().lower()) for run, i, n in got if i > 10_000_000) == sorted(x for x in offered if x not in known)
    assert 0 < sum(x in known for x in offered) < len(offered)


def test_role_match_has_both_directions(spark):
    titles = {r.role for r in A.records(spark, DIR).select("role").distinct().collect()}
    got = {(r.required, r.actual): r.result for r in queries.role_match(spark, DIR).collect()}
    assert set(got) == {(a, b) for a in titles for b in titles}
    assert got["Java Backend Developer", "Backend Engineer"] == "UNKNOWN" and got["Backend Engineer", "Java Backend Developer"] == "MATCH"


def test_stored_tables(spark):
    from fieldproof.sources import tables

    df = tables.stored(spark.range(5))
    assert df.count() == 5
    where = df._stored_at.removeprefix("file://")
    assert Path(where).exists()
    tables.discard(df)
    assert not Path(where).exists()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from fieldproof.sources import tables

    conf = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(SimpleNamespace(conf=conf, sparkContext=context))
