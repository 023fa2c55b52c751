"""Documents that say no word: queries give the rows that their SQL gives."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dialex.plans import registry
from dialex.plans.corpus import Corpus


@pytest.fixture(scope="module")
def wordless(spark, sf_dir, tmp_path_factory):
    """The smallest tables, with nine documents more: no text, an empty one, or digits and signs."""
    at = tmp_path_factory.mktemp("wordless")
    for t in ("labels", "pages", "benchmark", "conversations", "embeddings"):
        (at / f"{t}.parquet").symlink_to(Path(sf_dir) / f"{t}.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = F.array(F.lit(None).cast("string"), F.lit(""), F.lit("12 -- 345\n!"))
    odd = docs.limit(9).withColumn("doc_id", F.col("doc_id") + 100_000).withColumn("text", texts[F.pmod("doc_id", F.lit(3)).cast("int")])
    docs.unionByName(odd).coalesce(1).write.parquet(str(at / "documents.parquet"))
    yield str(at)
    Corpus.of(spark, str(at)).close()


@pytest.mark.parametrize("name", ["fingerprints", "gates", "mt_score", "consensus_choice"])
def test_documents_without_words_match_the_sql(spark, wordless, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        at = Path(wordless) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if at.is_dir() else ''}'")
    df = registry.queries()[name](spark, wordless)
    plain = lambda rows: sorted((tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in rows), key=str)
    sql = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert plain(df.collect()) == plain(sql)
