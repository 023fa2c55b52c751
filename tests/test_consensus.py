"""Consensus of directories: one shuffle of the files' words, and the share that agrees."""

import re

from dialex.operators import audit

FILES = [(1, n, w, c) for n, said in {"a": "x3 y4", "b": "x3 y4 z1", "c": "q9"}.items() for w, c in ((s[0], int(s[1:])) for s in said.split())] + [(2, "d", "x", 1), (3, "e", "x", 1)]


def test_consensus_and_names_without_words(spark):
    files = spark.createDataFrame(FILES, "film_id long, name string, word string, count long")
    chosen = spark.createDataFrame([(1, "a"), (2, "d"), (3, "none"), (4, "f")], "film_id long, name string")
    assert {r.film_id: r.consensus for r in audit.directory_consensus(files, chosen).collect()} == {1: 0.5, 2: 1.0, 3: 0.0, 4: 1.0}


def test_words_are_not_shuffled_by_file_and_word(spark):
    files = spark.createDataFrame(FILES, "film_id long, name string, word string, count long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as at size
    try:
        plan = audit.directory_consensus(files, files.groupBy("film_id").agg({"name": "min"}).toDF("film_id", "name"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"hashpartitioning\([^)]*word#", plan)
