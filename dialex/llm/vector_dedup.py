"""Near-duplicate vectors by sorted projection passes.

Each pass hashes a vector, less the mean of all, to sign bits of random projections, orders all vectors by the bits read
as one number, and compares every vector with a bounded window of neighbours in that order; similar vectors share long
prefixes in some pass. Windows go on over the bounds of tasks. Verified pairs of all passes are united into components.

A vector whose window is full of vectors that are alike but don't link stands in a crowd, where short prefixes say
little. Crowds go through many more passes, with wider windows, less the mean of the crowded vectors.

Links lie within components, so the links themselves are then counted exactly, tile by tile inside each component: what
a window misses in a group of copies isn't lost. Equal vectors are one representative with a multiplicity throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from dialex.llm.arrow_groups import matrix, runs
from dialex.llm.common import bound_arrow, materialise, partitions, remove, table
from dialex.llm.components import Forest, connected_components, tiles
from dialex.llm.topk import usable

PASSES, BITS, WINDOW, SEED = 16, 62, 64, 11
#: Passes and window of vectors that stand in a crowd: over half of their neighbours have a cosine of ALIKE or more, but
#: don't link.
CROWD_PASSES, CROWD_WINDOW, ALIKE = 48, 256, 0.8
#: Dimensions whose mean is taken off, the most frequent ones: a bound on what is broadcast. Others are hashed as they are.
MEANS = 64
TILE_ROWS = 2048
CHUNK = 512
#: What windows find: links (a, b), vectors a in a crowd, and the rows next to the bounds of a task.
LINK, CROWDED, BOUND = 0, 1, 2


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = (v / np.abs(v).max(axis=1, keepdims=True) for v in (a, b))
    return (a @ b.T) / np.outer(np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1)))


def _by_dim(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        lengths = batch.column(column).value_lengths().to_numpy()
        for dim in np.unique(lengths).tolist():
            yield dim, batch.filter(pa.array(lengths == dim))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, n, total): how many vectors of a dimension, and the sum of their unit vectors."""
    sums: dict[int, np.ndarray] = {}
    for dim, part in _by_dim(batches, 0):
        sums[dim] = sums.get(dim, np.zeros(dim + 1)) + np.append(unit(matrix(part.column(0), np.float64)).sum(axis=0), part.num_rows)
    arrays = [pa.array(list(sums), pa.int32()), pa.array([s[-1] for s in sums.values()], pa.float64()), pa.array([s[:-1] for s in sums.values()], pa.list_(pa.float64()))]
    yield pa.RecordBatch.from_arrays(arrays, names=["dim", "n", "total"])


def means(vectors: DataFrame) -> DataFrame:
    """(dim, mean): the mean of the unit vectors of the MEANS most frequent dimensions, a row a dimension; sums are of
    decimals, so that they don't depend on the order of rows."""
    parts = vectors.select("v").mapInArrow(_sums, "dim int, n double, total array<double>").select("dim", "n", F.posexplode("total").alias("i", "x"))
    mean = (F.sum(F.col("x").cast("decimal(38,12)")).cast("double") / F.sum("n")).cast("float").cast("double")
    per = parts.groupBy("dim", "i").agg(mean.alias("x"), F.sum("n").alias("n"))
    found = per.groupBy("dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"), F.max("n").alias("n"))
    return found.orderBy(F.desc("n"), "dim").limit(MEANS).select("dim", "mean")


def _project(batches: Iterator[pa.RecordBatch], passes: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(dim, pass, key, node, v): rows (node, mean, v) once a pass, with the sign bits of v less its mean as an integer."""
    planes: dict[int, np.ndarray] = {}
    for dim, part in _by_dim(batches, 2):
        n = part.num_rows
        if dim not in planes:
            planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, passes * BITS))
        centred = unit(matrix(part.column(2), np.float64))
        if part.column(1)[0].is_valid:  # all of a dimension or none
            centred -= matrix(part.column(1), np.float64)
        for p in range(passes):
            keys = (centred @ planes[dim][:, p * BITS : (p + 1) * BITS] > 0).astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, p, np.int32)), pa.array(keys), part.column(0), part.column(2)], names=["dim", "pass", "key", "node", "v"])


def compare(nodes: np.ndarray, v: np.ndarray, new: int, least: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows, those from `new` on compared with at least `window` rows before each: pairs that join what the
    links found join, and the nodes of rows in a crowd."""
    pairs, crowded = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
    for at in range(new, len(nodes), CHUNK):
        lo, hi = max(0, at - window), min(at + CHUNK, len(nodes))
        near = cosines(v[at:hi], v[lo:hi])
        back = np.arange(at, hi)[:, None] - np.arange(lo, hi)[None, :]
        alike = ((near >= ALIKE) & (near < least) & (back > 0) & (back <= window)).sum(axis=1)
        crowded.append(nodes[at:hi][alike > window // 2])
        i, j = np.nonzero((near >= least) & (back > 0))
        forest = Forest(hi - lo)
        found = [(x, y) for x, y in zip((i + at - lo).tolist(), j.tolist(), strict=True) if forest.join(x, y)]
        if found:
            pairs.append(nodes[np.array(found) + lo])
    return np.concatenate(pairs), np.concatenate(crowded)


def _windows(batches: Iterator[pa.RecordBatch], least: float, window: int, bounds: bool) -> Iterator[pa.RecordBatch]:
    """(kind, a, b, dim, pass, key, v): links and crowded nodes among the sorted rows of each (dim, pass), and, with
    `bounds`, the first and last `window` rows of each that this task holds."""
    names = ["kind", "a", "b", "dim", "pass", "key", "v"]
    tail: tuple[tuple, pa.Table] | None = None

    def out(kind: int, rows: int, a: pa.Array, b: pa.Array, rest: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows, kind, np.int8)), a, b, *rest], names=names)

    def edge(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        cols = {c: t.column(c).combine_chunks() for c in t.column_names}
        cols = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in cols.items()}
        return out(BOUND, t.num_rows, cols["node"], pa.nulls(t.num_rows, pa.int64()), [cols["dim"], cols["pass"], cols["key"], cols["v"]])

    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.schema.field("v").type
        for key, t in runs(iter([batch]), 2):
            held = tail[1] if tail and tail[0] == key else None
            if bounds and held is None:
                if tail:
                    yield edge(tail[1])
                yield edge(t.slice(0, window))
            both = pa.concat_tables([held, t]) if held is not None else t
            nodes, new = both.column("node").to_numpy(), held.num_rows if held is not None else 0
            pairs, crowded = compare(nodes, matrix(both.column("v"), np.float64), new, least, window)
            for what, a, b in ((LINK, pairs[:, 0], pa.array(np.ascontiguousarray(pairs[:, 1]))), (CROWDED, crowded, pa.nulls(len(crowded), pa.int64()))):
                if n := len(a):
                    yield out(what, n, pa.array(np.ascontiguousarray(a)), b, [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, kind)])
            tail = (key, both.slice(max(0, both.num_rows - window)))
    if bounds and tail:
        yield edge(tail[1])


def _passes(vectors: DataFrame, least: float, passes: int, window: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) of links and (node) of crowded vectors among rows (node, v), from so many passes."""
    kind = vectors.schema["v"].dataType.simpleString()
    centred = vectors.withColumn("dim", F.size("v")).join(F.broadcast(materialise(means(vectors), "means")), "dim", "left").select("node", "mean", "v")
    keyed = centred.mapInArrow(partial(_project, passes=passes, seed=seed), f"dim int, pass int, key long, node long, v {kind}")
    order = ["dim", "pass", "key", "node"]
    ordered = keyed.repartitionByRange(partitions(vectors.sparkSession), *order).sortWithinPartitions(*order)
    schema = f"kind byte, a long, b long, dim int, pass int, key long, v {kind}"
    met = materialise(ordered.mapInArrow(partial(_windows, least=least, window=window, bounds=True), schema), "met")
    edges = met.where(F.col("kind") == BOUND).select("dim", "pass", "key", F.col("a").alias("node"), "v").distinct()
    edges = edges.repartition("dim", "pass").sortWithinPartitions(*order)
    over = materialise(edges.mapInArrow(partial(_windows, least=least, window=window, bounds=False), schema), "over").where(F.col("kind") == LINK)
    links = met.where(F.col("kind") == LINK).unionAll(over).select("a", "b").distinct()
    return links, met.where(F.col("kind") == CROWDED).select(F.col("a").alias("node")).distinct()


def _tile_links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(node, links, met): for each row of a tile, the rows of the other side that it links with, multiplicities
    counted, and the smallest of them."""
    for (_, i, j), t in runs(batches, 3):
        node, n, side = t.column("node").to_numpy(), t.column("n").to_numpy(), t.column("side").to_numpy()
        v = matrix(t.column("v"), np.float64)
        if i == j:
            near = cosines(v, v) >= least
            np.fill_diagonal(near, False)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(near @ n)], names=["node", "links"])
        elif side.any() and not side.all():
            one, two = side == 0, side == 1
            near = cosines(v[one], v[two]) >= least
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[one], node[two]])), pa.array(np.concatenate([near @ n[two], near.T @ n[one]]))], names=["node", "links"])


def near_duplicates(rows: DataFrame, least: float = 0.95, passes: int = PASSES, window: int = WINDOW, seed: int = SEED, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id, n_links, component) for every row of (id, v).

    Vectors link at a cosine of `least` or more, in double precision, with vectors of their own dimension. Rows without
    an id, and null, empty, zero or partly null or non-finite vectors link with nothing and are their own component.
    Equal rows link with each other; ids should be unique, or equal ids count as one node with that many rows. An empty
    table gives an empty result. A link that no pass brings together is missed; inside components none is.
    """
    bound_arrow(rows.sparkSession)
    fine = F.coalesce(F.col("id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0), F.lit(False))
    kind = "float" if rows.schema["v"].dataType == ArrayType(FloatType(), rows.schema["v"].dataType.containsNull) else "double"
    vectors = materialise(rows.where(fine).select(F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast(kind) + F.lit(0.0).cast(kind)).alias("v")), "vectors")
    reps = materialise(vectors.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("n")), "reps")
    links, crowded = _passes(reps.select("node", "v"), least, passes, window, seed)
    crowd = materialise(reps.select("node", "v").join(crowded, "node", "left_semi"), "crowd")
    if not crowd.isEmpty():
        links = links.unionAll(_passes(crowd, least, CROWD_PASSES, CROWD_WINDOW, seed + 1)[0])
    edges = materialise(links.distinct(), "edges")
    comps = materialise(connected_components(edges), "components")
    remove(edges)
    members = tiles(reps.join(comps, "node"), "component", tile_rows)
    dealt = members.select("component", "tile_i", "tile_j", "side", "node", "n", "v").repartition("component", "tile_i", "tile_j").sortWithinPartitions("component", "tile_i", "tile_j")
    counted = dealt.mapInArrow(partial(_tile_links, least=least), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    grouped = reps.join(counted, "node", "left").join(comps, "node", "left")
    grouped = grouped.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    linked = vectors.join(grouped, "v").select("id", "n_links", "component")
    return linked.unionAll(rows.where(~fine).select("id", F.lit(0).cast("long"), "id"))


def op9_vector_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors, whatever their labels. Rows without an id and vectors that are null, zero, or hold
    null or non-finite components link with nothing; an empty table gives no row."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = near_duplicates(rows)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_vector_near_dup": op9_vector_near_dup}
ORACLES: dict[str, str] = {
    "op9_vector_near_dup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), r AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a
), c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT t.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, t.vec_id = c.component_id AS kept
FROM embeddings t JOIN c ON c.node = t.vec_id LEFT JOIN n ON n.a = t.vec_id
"""
}
