"""Exact top-k search by integer inner product over an impact-ordered index, score at a time.

Vectors are cut into blocks; a block's postings (component, row, value) stand in segments by descending quantised
impact, the bit length of the value. A search adds up segments from the highest impact down and bounds what the rest can
still add or take, by the largest values left in each component and by the length of what is left of each row. It stops
when the bounds prove that few rows can be among the best, and scores those exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialex.llm.arrow_groups import matrix, runs
from dialex.llm.common import bound_arrow, materialise, table

BLOCK_ROWS = 4096
#: Blocks of the index that a task holds at a time, and how many tasks a core should have before it holds more.
HELD_BLOCKS, TASKS_A_CORE = 8, 4
#: Queries that go to a block of the index together, and of them those that are scored at a time.
QUERY_ROWS, SCORED = 4096, 512
EXACT = 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components; null and empty ones are not usable."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def integer_vector(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, held at the limits of a long."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v) dealt by hash into blocks of about `size` rows of one dimension, sorted: (dim, block, id, v)."""
    dims = rows.withColumn("dim", F.size("v"))
    counts = dims.groupBy("dim").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = dims.join(counts, "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return dealt.select("dim", "block", "id", "v").repartition("dim", "block").sortWithinPartitions("dim", "block", "id")


@dataclass
class Segments:
    """The postings of a block by descending impact: those of level i are comps, rows and vals from ends[i] to ends[i + 1].
    norms[i] and tops[i] bound what comes after level i: the length of what is left of each row, and the largest value
    left in each component."""

    ends: np.ndarray
    comps: np.ndarray
    rows: np.ndarray
    vals: np.ndarray
    norms: np.ndarray
    tops: np.ndarray

    @staticmethod
    def of(values: np.ndarray) -> Segments:
        rows, comps = np.nonzero(values)
        vals = values[rows, comps]
        impact = -np.frexp(np.abs(vals.astype(np.float64)))[1].astype(np.int16)
        order = np.lexsort((comps, impact))
        levels, starts = np.unique(impact[order], return_index=True)
        sizes = np.abs(values.astype(np.float64))
        norms, tops = np.zeros((len(levels), len(values))), np.zeros((len(levels), values.shape[1]))
        for i, level in enumerate(levels):
            left = np.where(sizes < np.ldexp(0.5, -int(level)), sizes, 0)
            norms[i], tops[i] = np.sqrt((left * left).sum(axis=1)), left.max(axis=0, initial=0)
        return Segments(np.append(starts, len(order)).astype(np.int64), comps[order].astype(np.int32), rows[order].astype(np.int32), vals[order], norms, tops)


SEGMENTS = [f.name for f in fields(Segments)]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's ids and its posting segments."""
    for (dim, block), t in runs(batches, 2):
        found = Segments.of(matrix(t.column("v"), np.int64))
        cols = [t.column("id").to_numpy().astype(np.int64), *[getattr(found, c) for c in SEGMENTS]]
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([block], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cols]], names=["dim", "block", "ids", *SEGMENTS])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (dim, block), t in runs(batches, 2):
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([block], pa.int32()), pa.array([t.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([matrix(t.column("v"), np.int64).tobytes()], pa.binary())], names=["dim", "qblock", "qids", "qvals"])


def search_block(q: np.ndarray, qids: np.ndarray, ids: np.ndarray, block: Segments, k: int, floor: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, int]:
    """The k best of a block for each query, as far as they reach `floor` (a proven score of k other rows).

    Segments are added up until the bounds leave few rows in question; the postings of these rows alone are then read
    from all segments, for exact scores. Bounds are widened by what doubles can be off, a share of the lengths.
    Gives (query id, id, score) rows, the raised floors, and how many segments were added up.
    """
    dim, n, ends = q.shape[1], len(ids), block.ends
    qf = q.astype(np.float64)
    qlen = np.sqrt((qf * qf).sum(axis=1))
    scores = np.zeros((len(q), n))
    own = qids[:, None] == ids[None, :]
    whole = np.sqrt(np.bincount(block.rows, block.vals.astype(np.float64) ** 2, n))
    slack = np.outer(qlen, whole) * (4 * (dim + len(ends)) * np.finfo(np.float64).eps)
    few, used = max(4 * k, n // 64), 0
    alive = ~own
    for used, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True), 1):  # noqa: B007
        comps, at = np.unique(block.comps[lo:hi], return_inverse=True)
        part = np.zeros((len(comps), n))
        part[at, block.rows[lo:hi]] = block.vals[lo:hi]
        scores += qf[:, comps] @ part
        reach = np.minimum(np.outer(qlen, block.norms[used - 1]), (np.abs(qf) @ block.tops[used - 1])[:, None]) * (1 + 1e-9) + slack
        # bounds are held at the limits of a long as scores are: what ties there is decided by ids, not here
        low = np.where(own, -np.inf, np.clip(scores - reach, LEAST, MOST))
        bound = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), -np.inf)
        alive = ~own & (np.clip(scores + reach, LEAST, MOST) >= np.maximum(bound, floor)[:, None])
        if alive.sum(axis=1).max(initial=0) <= few:
            break
    out, floor = [], floor.copy()
    members = np.flatnonzero(alive.any(axis=0))
    place = np.full(n, -1)
    place[members] = np.arange(len(members))
    mine = place[block.rows] >= 0
    dense = np.zeros((dim, len(members)), np.int64)
    dense[block.comps[mine], place[block.rows[mine]]] = block.vals[mine]
    real = dense.astype(np.float64)
    small = float(np.abs(qf).sum(axis=1).max(initial=0)) * float(np.abs(real).max(initial=0)) < EXACT
    for i in np.flatnonzero(alive.any(axis=1)):
        at = np.flatnonzero(alive[i])
        if small:
            exact = np.rint(qf[i] @ real[:, place[at]]).astype(np.int64)
        else:
            sums = [sum(int(a) * int(b) for a, b in zip(q[i], dense[:, j], strict=True)) for j in place[at]]
            exact = np.array([min(max(x, LEAST), MOST) for x in sums], dtype=np.int64)
        best = np.lexsort((ids[at], -1 - exact))[:k]  # -1 - x falls as x rises, and no long is too small for it
        out += [(int(qids[i]), int(ids[at[j]]), int(exact[j])) for j in best]
        if len(best) == k:
            floor[i] = max(floor[i], np.nextafter(float(exact[best[-1]]), -np.inf) if not small else float(exact[best[-1]]))
    return out, floor, used


def _opened(r: dict) -> tuple[np.ndarray, Segments]:
    ids = np.frombuffer(r["ids"], np.int64)
    ints = [np.frombuffer(r[c], kind) for c, kind in zip(SEGMENTS[:4], (np.int64, np.int32, np.int32, np.int64), strict=True)]
    norms, tops = (np.frombuffer(r[c], np.float64).reshape(-1, width) for c, width in (("norms", len(ids)), ("tops", r["dim"])))
    return ids, Segments(*ints, norms, tops)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by part: its blocks of the index first, which are held, then the blocks of queries, one by one."""
    held, part = [], None
    for batch in batches:
        for r in batch.to_pylist():
            if (r["dim"], r["part"]) != part:
                held, part = [], (r["dim"], r["part"])
            if r["qids"] is None:
                held.append(_opened(r))
                continue
            qids = np.frombuffer(r["qids"], np.int64)
            q = np.frombuffer(r["qvals"], np.int64).reshape(len(qids), r["dim"])
            for lo in range(0, len(qids), SCORED):
                at = slice(lo, lo + SCORED)
                floor = np.full(len(qids[at]), -np.inf)
                for ids, block in held:
                    found, floor, _ = search_block(q[at], qids[at], ids, block, k, floor)
                    cols = list(zip(*found, strict=True)) or [[]] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The impact-ordered index of rows (id, v): a row a block; every vector is in it."""
    bound_arrow(vectors.sparkSession)
    schema = "dim int, block int, ids binary, " + ", ".join(f"{c} binary" for c in SEGMENTS)
    return _blocks(vectors, block_rows).mapInArrow(_index, schema)


def search(index: DataFrame, queries: DataFrame, k: int = 5, query_rows: int = QUERY_ROWS, held_blocks: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with other ids, ties to smaller ids.

    The index is dealt into parts of a few blocks, once; queries (id, v) come in blocks and go to each part of their
    dimension, so what is shuffled is the index once and the queries once a part. Scores are exact, and held at the
    limits of a long beyond them, where smaller ids come first; the row with the query's own id is left out. Of queries
    that share an id the one with the smallest vector is asked.
    """
    asked = queries.groupBy("id").agg(F.min("v").alias("v"))
    packed = _blocks(asked, query_rows).mapInArrow(_packed, "dim int, qblock int, qids binary, qvals binary")
    cores = index.sparkSession.sparkContext.defaultParallelism
    per = F.lit(held_blocks) if held_blocks else F.greatest(F.lit(1), F.least(F.lit(HELD_BLOCKS), F.floor(F.col("blocks") / (TASKS_A_CORE * cores))))
    dims = index.groupBy("dim").agg((F.max("block") + 1).alias("blocks")).withColumn("per", per).withColumn("parts", F.ceil(F.col("blocks") / F.col("per")))
    part = lambda c: c.cast("int").alias("part")
    blocks = index.join(dims, "dim").select("dim", part(F.floor(F.col("block") / F.col("per"))), F.lit(0).alias("kind"), "block", "ids", *SEGMENTS, *[F.lit(None).cast("binary").alias(c) for c in ("qids", "qvals")])
    rows = packed.join(dims, "dim").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("dim", part(F.col("part")), F.lit(1).alias("kind"), F.col("qblock").alias("block"), *[F.lit(None).cast("binary").alias(c) for c in ("ids", *SEGMENTS)], "qids", "qvals")
    met = blocks.unionByName(rows).repartition("dim", "part").sortWithinPartitions("dim", "part", "kind", "block").drop("kind", "block")
    found = met.mapInArrow(partial(_search, k=k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 of all vectors for every row whose id is divisible by 50. Rows without an id or with unusable vectors take
    no part; vectors meet only those of their own dimension; components and scores beyond a long are held at its limits,
    where ties go to smaller ids; of query rows that share an id the smallest vector is asked; an empty table gives no
    row."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    vectors = rows.select(F.col("vec_id").alias("id"), integer_vector(F.col("embedding"), 256.0).alias("v"))
    index = materialise(build_index(vectors), "index")
    return search(index, vectors.where(F.col("id") % 50 == 0), 5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_top_k": op8_top_k}
ORACLES: dict[str, str] = {
    "op8_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
