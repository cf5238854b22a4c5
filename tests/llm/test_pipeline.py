"""The pipeline's stages against brute force, and its queries against SQL and rules."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from fieldproof.llm import language, queries


def test_stages(spark, tmp_path):
    words = [f"w{i}" for i in range(500)]
    say = lambda k, n: " ".join(random.Random(k).choices(words, k=n))
    rows = [(i, say(i, 80), "en", f"s{i % 2}", 10) for i in range(30)]
    rows += [(50, rows[3][1], "en", "s0", 1), (51, None, "en", "s0", 0), (52, "123 456", "en", "s1", 7), (53, "leak " + say(99, 12), "en", "s1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, say(99, 12))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        left = stage(spark, left, str(tmp_path)).persist()
        assert left.columns == corpus_pipeline.COLUMNS
        seen[name] = sorted(r.doc_id for r in left.collect())
    assert seen["language"] == [*range(30), 50, 53]
    assert seen["near_dedup"] == [*range(30), 53]
    assert seen["decontamination"] == list(range(30))
    assert set(seen["mixing"]) <= set(range(30)) and max(map(seen["mixing"].count, seen["mixing"])) <= 3
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == seen["mixing"] and {r.shard for r in out} <= set(range(8))


def test_every_operator_has_its_query():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


def test_a_source_that_is_one_long_document_keeps_its_quota(spark):
    words = lambda k, n: " ".join(f"{k}x{i}" for i in range(n))
    rows = [(10 * s + i, words(f"s{s}d{i}", 100), "en", f"s{s}", 1) for s in (0, 1) for i in range(10)] + [(99, "  " + words("z", 2000).replace(" ", "\n "), "en", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix_sources(spark, docs, "").collect()
    # quotas of 4,000 words at 5 : 2 : 1
    assert {s: sum(len(r.text.split()) for r in got if r.source == s) for s in ("s0", "s1", "s2")} == {"s0": 2500, "s1": 1000, "s2": 500}
    part = [r for r in got if r.source == "s2"]
    assert len(part) == 1 and rows[-1][1].startswith(part[0].text) and part[0].n_chars == len(part[0].text)


def test_language_stage(spark):
    kinds = {"aa": ["the", "with", "and", "from", "shall"], "bb": ["der", "und", "nicht", "für", "schön"], "cc": ["que", "para", "como", "los"]}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(rng.randint(3, 60))), k, "s", 1) for i, k in enumerate(sorted(kinds) * 40)]
    rows += [(1000, None, None, "s", 0), (1001, "123 !!", None, "s", 6), (1002, "ok", None, "s", 2)]
    strange = [(1003 + i, " ".join("".join(rng.choice("ζξψφχθ") for _ in range(6)) for _ in range(30)), None, "s", 1) for i in range(20)]
    df = spark.createDataFrame(rows + strange, "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda d: sorted(r.doc_id for r in d.collect())
    clean = [*range(120), 1002]
    assert kept(corpus_pipeline.identify_language(spark, df, "")) == clean
    # clean documents that were not learned from stay too
    learned = language.prototypes(df.where("doc_id % 5 <> 0"))
    assert kept(corpus_pipeline.of_known_language(language.identify(df, learned, keep=corpus_pipeline.COLUMNS[1:]))) == clean
    unnamed = df.withColumn("lang", F.lit(None).cast("string"))
    assert kept(corpus_pipeline.identify_language(spark, unnamed, "")) == [*clean, *(r[0] for r in strange)]


def test_stages_with_odd_rows(spark, tmp_path):
    """Empty tables, repeated rows, nulls in any column, and columns with the names of results."""
    bench = "item_id long, text string"
    spark.createDataFrame([(1, "never seen words"), (2, None)], bench).write.parquet(str(tmp_path / "benchmark.parquet"))
    kind = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, size string, slot string, component_id string, kept string, n_hit string, times string"
    more = ("x",) * 8
    say = lambda k, n: " ".join(random.Random(k).choices([f"w{i}" for i in range(300)], k=n))
    rows = [(i, say(i, 60), "en", f"s{i % 2}", 5, *more) for i in range(12)]
    rows += [rows[3], (4, say(100, 60), "en", "s0", 5, *more), (None, say(5, 60), "en", None, None, *more), (20, None, None, None, None, *(None,) * 8), (21, "", "en", "s0", 0, *more), (22, say(77, 30_000), "en", "s1", 1, *more)]
    for own in (rows, []):
        docs = spark.createDataFrame(own, kind)
        left = docs
        for name, stage in corpus_pipeline.STAGES:
            if name == "sharding":
                break
            left = stage(spark, left, str(tmp_path)).persist()
            assert left.columns == corpus_pipeline.COLUMNS
            if own and name == "near_dedup":
                got = {r.doc_id: r for r in left.collect()}
                assert sorted(got) == [*range(12), 22] and got[4].text == max(rows[4][1], say(100, 60))
        out = stage(spark, left, str(tmp_path))
        assert {"shard", "slot", "size", "text_crc32"} <= set(out.columns)
        assert (out.count() > 0) == bool(own)
