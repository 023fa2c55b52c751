"""Exact de-duplication against a dictionary of texts."""

import hashlib
from collections import defaultdict

import pytest

from dialex.llm import exact_dedup


def brute_force(rows, pick):
    ids = defaultdict(list)
    for d, t in rows:
        ids[t or ""].append(d)
    out = []
    for d, t in rows:
        known = [x for x in ids[t or ""] if x is not None]
        keep = pick(known) if known else None
        out.append((d, keep, len(ids[t or ""]), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize(("keep", "hot", "least"), [("min", 2048, 1000), ("max", 2048, 1000), ("max", 4, 2), ("min", 2, 5)])
def test_hard_rows(spark, hard, keep, hot, least):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    got = exact_dedup.exact_duplicates(hard, keep, hot_texts=hot, least=least)
    assert rows_of(got) == brute_force(rows, min if keep == "min" else max)


def test_a_crowd_that_holds_a_third_of_all_rows(spark):
    start = "the same beginning " * 20
    rows = [(i, "copy" if i % 3 == 0 else start + str(i // 2)) for i in range(3000)] + [(None, "copy"), (None, "only without id"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(exact_dedup.exact_duplicates(docs, "max", hot_texts=10, least=100)) == brute_force(rows, max)


def test_bytes_decide(spark):
    rows = [(1, "é"), (2, "é"), (3, "A"), (4, "a"), (5, "a "), (6, "a\x00"), (7, "x" * 200_000), (8, "x" * 200_000), (9, "x" * 199_999 + "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(exact_dedup.exact_duplicates(docs)) == brute_force(rows, min)


def test_empty_and_other_columns(spark, empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    odd = spark.createDataFrame([("b", "t", 1), ("a", "t", 2), ("c", "u", 3)], "key string, body string, h long")
    got = exact_dedup.exact_duplicates(odd, id_col="key", text_col="body")
    assert {(r.doc_id, r.keep_id, r.kept) for r in got.collect()} == {("a", "a", True), ("b", "a", False), ("c", "c", True)}


def test_sort_streams_over_ranges(spark):
    """One exchange of texts, by range, with an aggregate that streams over the sorted rows."""
    docs = spark.range(100).selectExpr("id AS doc_id", "cast(id % 7 AS string) AS text")
    plan = exact_dedup._classes(docs, spark.createDataFrame([], "h long"), "max")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(prefix" in plan and "SortAggregate(key=[prefix" in plan and "Python" not in plan


def test_registered_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows_of(exact_dedup.op12_exact_dedup(spark, sf_dir)) == brute_force([(r.doc_id, r.text) for r in docs.collect()], max)
