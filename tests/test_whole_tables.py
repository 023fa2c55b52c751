"""Queries over whole tables, on one that has ids beyond the subsets of other queries."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from dialex.plans import entities, registry
from tests.test_oracles import TABLES, plain

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(SF_DIR).exists():
        pytest.skip("no test data here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize(("name", "key", "beyond"), [("directory_consensus", "film_id", 40), ("mislabel_victim", "a", 40), ("swears_per_film", "film_id", 400)])
def test_all_ids_are_seen(spark, duck, name, key, beyond):
    df = registry.queries()[name](spark, SF_DIR)
    got = df.select(*sorted(df.columns)).collect()
    assert max(r[key] for r in got) >= beyond
    sql = duck.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(map(plain, r)) for r in got), key=str) == sorted((tuple(map(plain, r)) for r in sql), key=str)


def test_rare_words_of_a_large_dictionary(spark):
    """The rarest word is said least, so it comes after a million others in a board by count."""
    words = spark.range(1_000_000).selectExpr("explode(array(1L, 2L)) AS film_id", "concat('w', id) AS word", "1L AS count")
    words = words.unionAll(spark.createDataFrame([(1, "zz", 1)], "film_id long, word string, count long"))
    assert entities.rare_sort(SimpleNamespace(words=words, stopwords=["the"])).first().word == "zz"
