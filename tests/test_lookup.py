"""Pages deep in an order, and texts found by an index, against the plain scans."""

import random

import pytest
from pyspark.sql import functions as F

from fieldproof.operators import explore, lookup
from fieldproof.sources.tables import owner

VALUES = ["₹2 lakh", "—", "10", "abc", None, "₹1 Cr", "item 9", "Item 10", "10", "", "0.5", "Zürich"]


@pytest.fixture(scope="module")
def rows(spark):
    pick = random.Random(4)
    return spark.createDataFrame([(i, pick.choice(VALUES)) for i in range(300)], "id int, v string")


@pytest.mark.parametrize("descending", [False, True])
def test_pages(spark, rows, descending):
    whole = [r.id for r in explore.dataset_page(rows, F.col("v"), "id", descending, size=300).collect()]
    with owner():
        pages = lookup.paged(rows, F.col("v"), "id", descending)
        assert [(r.position, r.id) for r in pages.orderBy("position").collect()] == list(enumerate(whole, 1))
        for page in (1, 2, 30, 31):
            got = lookup.page_of(pages, page).orderBy("position")
            assert [r.id for r in got.collect()] == whole[(page - 1) * 10 : page * 10]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(position" in plan and "LessThanOrEqual(position" in plan


@pytest.mark.parametrize("descending", [False, True])
def test_page_after_each_row(spark, rows, descending):
    small = rows.where("id < 40")
    whole = explore.dataset_page(small, F.col("v"), "id", descending, size=40).collect()
    for k in range(0, 40, 7):
        got = lookup.page_after(small, F.col("v"), "id", (whole[k].v, whole[k].id), descending, size=4)
        assert got.columns == ["id", "v"]
        assert [r.id for r in got.collect()] == [r.id for r in whole[k + 1 : k + 5]]


def test_page_after_a_row_that_is_gone(spark):
    df = spark.createDataFrame([(1, "5"), (3, "7"), (4, None)], "id int, v string")
    assert [r.id for r in lookup.page_after(df, F.col("v"), "id", ("6", 2)).collect()] == [3, 4]
    assert lookup.page_after(df.limit(0), F.col("v"), "id", ("6", 2)).collect() == []


TEXTS = ["Stainless STEEL kettle", None, "", "st", "teel ste", "Zürich 北京市 steel", "steelsteel", "😀😀 tee", "a  steel", "eel"]


def test_index_finds_what_a_scan_finds(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BITS", 2)  # blocks of four rows
    df = spark.createDataFrame([(i, TEXTS[i * 7 % len(TEXTS)]) for i in range(97)], "id int, t string")
    with owner():
        index = lookup.text_index(df, ["id"], F.col("t"))
        for q in ("steel", " STEEL ", "st", "", "京市 ", "😀 t", "😀😀", "zürich", "teel ste", "absent", "ste ste"):
            want = [r.id for r in df.where(F.contains(F.lower("t"), F.lit(q.lower().strip()))).orderBy("id").collect()]
            assert sorted(r.id for r in lookup.find(index, q).collect()) == want, q
            for cap in (0, 1, 5, 500) if q in ("steel", "st", "absent") else (3,):
                assert sorted(r.id for r in lookup.find(index, q, cap).collect()) == want[:cap], (q, cap)
        assert index.postings.agg(F.max(F.size("members"))).first()[0] <= 4
        empty = lookup.text_index(df.limit(0), ["id"], F.col("t"))
        assert lookup.find(empty, "steel").collect() == lookup.find(empty, "steel", 3).collect() == []


def test_indexed_search_equals_the_scan(spark):
    records = spark.createDataFrame([(f"R{i % 3}", i, f"Acme {i}", None if i % 4 else "React Developer", {"Brand": "B" * (i % 3), "Place": "Pune"}) for i in range(50)], "run_id string, record_id int, entity_name string, role string, attributes map<string,string>")
    requests = spark.createDataFrame([(1, "Find react jobs", "x"), (2, "Other", "REACT"), (3, "None", "none")], "request_id int, name string, prompt string")
    with owner():
        index = lookup.record_index(records)
        for q in ("react", "pune", "bb pune", "ac", "nothing at all"):
            assert sorted(lookup.indexed_search(requests, index, q).collect()) == sorted(explore.search(requests, records, q).collect()), q


def test_postings_shuffle_texts_and_not_their_grams(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BITS", 3)
    texts = ["steel ste", "", None, "ab", "😀😀😀😀", "京市x", "aaaa", "steel"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "n long, _text string").repartition(3)
    lists = lookup._lists(df)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "hashpartitioning(gram" not in plan
    want = {}
    for n, t in enumerate(texts):
        for g in {t[i : i + 3] for i in range(len(t) - 2)} if t else ():
            want.setdefault((g, n >> 3), []).append(n & 7)
    assert {(r.gram, r.block): r.members for r in lists.collect()} == want
