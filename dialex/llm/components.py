"""Connected components over edge tables, and tiles of large components for exact work inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialex.llm.common import materialise, partitions, remove


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: every node's neighbours (the larger ones, or the smaller ones and itself) are tied to its smallest neighbour.

    Edges of a node are spread over `part`, a hash of the neighbour, so that those of a star's centre go to many tasks;
    a node's minimum is sent to the parts that it has, which are no more than its edges or the partitions of a shuffle.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not larger:
        both = both.where("b < a")
    both = both.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(partitions(edges.sparkSession))).cast("int"))
    parts = both.groupBy("a", "part").agg(F.min("b").alias("m"))
    low = parts.groupBy("a").agg(F.min("m").alias("m")).withColumn("m", F.least("a", "m"))
    tied = both.where("b > a") if larger else both
    out = tied.join(parts.select("a", "part").join(low, "a"), ["a", "part"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        out = out.unionAll(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of `edges(a, b)`; component is the smallest node reachable.

    Alternating large and small stars until nothing changes. Minima are taken with map-side combining and a node's edges
    lie in many parts, so a node with very many edges costs no more than its edges and fills no one task, and each round is written to the shared folder: neither lineage nor
    anything on the driver grows. An empty edge table gives an empty result; self-loops and repeated edges don't matter.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    now = materialise(edges, "edges")
    mark = None
    for _ in range(max_rounds):
        large = materialise(_star(now, larger=True), "edges")
        small = materialise(_star(large, larger=False), "edges")
        remove(now)
        remove(large)
        now = small
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def tiles(members: DataFrame, component: str, block_rows: int) -> DataFrame:
    """Deals the rows of every component into blocks of about `block_rows` and pairs the blocks.

    Adds tile_i, tile_j (the pair of blocks) and side (0 or 1 when the row belongs to the first or second block; rows
    of a block paired with itself come once, with side 0). Each pair of rows of a component meets in exactly one tile,
    so a component of any size is worked off by many tasks that hold two blocks each. Sizes reach the rows by parts of a
    component, like the minima of stars.
    """
    spread = members.withColumn("_part", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(partitions(members.sparkSession))).cast("int"))
    parts = spread.groupBy(component, "_part").agg(F.count("*").alias("_n"))
    sizes = parts.select(component, "_part").join(parts.groupBy(component).agg(F.sum("_n").alias("_n")), component)
    blocks = spread.join(sizes, [component, "_part"]).withColumn("_b", F.ceil(F.col("_n") / F.lit(block_rows)).cast("int"))
    blocks = blocks.withColumn("_k", F.pmod(F.xxhash64("node"), F.col("_b")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    dealt = blocks.withColumn("_o", other)
    return dealt.withColumns({"tile_i": F.least("_k", "_o"), "tile_j": F.greatest("_k", "_o"), "side": (F.col("_k") > F.col("_o")).cast("int")}).drop("_n", "_b", "_k", "_o", "_part")


class Forest:
    """Union by smallest root over the integers 0..n-1, for what one task holds."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if x > y:
            x, y = y, x
        self.up[y] = x
        return True
