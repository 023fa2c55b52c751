"""Mixing of sources to target weights by entropy balancing, in built-in functions only.

Among all document rates that meet each source's token target, entropy balancing takes those nearest to one copy of
everything (in Kullback-Leibler divergence): rates tilted exponentially in the document's size, held at the largest
number of copies. The convex dual has one multiplier a source, found by Newton steps over counts by (source, size),
with a bracket that a step may not leave. Rates are rounded into copies so that a source's words stay near its target.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialex.llm.common import columns, materialise, remove, table, unused

WORD = "[^\\x20\\x09-\\x0D]+"
MOST_COPIES = 3
#: Rows that share source, size and bin are ranked together; bins keep such a group near this many rows.
BIN_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, sid, target) from (source, size) rows: the sources in code point order, null last, weigh
    1, 2, 3, repeating; all of them share the sum of sizes; a target stops at `most` times the source's size and the
    excess goes to the others by weight. One row a source, so the unpartitioned windows are small."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("low"), F.max("size").alias("high"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("sid", F.row_number().over(order)).withColumn("w", ((F.col("sid") - 1) % 3 + 1).cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    everything = Window.partitionBy(F.lit(1))
    before = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    src = src.withColumns({"total": F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything), "cap0": F.coalesce(F.sum("cap").over(before), zero), "w0": F.coalesce(F.sum("w").over(before), zero)})
    src = src.withColumn("capped", F.col("cap") <= F.col("w") * (F.col("total") - F.col("cap0")) / (F.col("all_w") - F.col("w0")))
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(zero)).over(everything)
    weight = F.sum(F.when(F.col("capped"), zero).otherwise(F.col("w"))).over(everything)
    return src.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * left / F.nullif(weight, zero))).select("source", "source_size", "sid", "target", "low", "high")


def _rate(lam: Column, size: Column, high: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(lam * size / high))


def solve(cells: DataFrame, sources: DataFrame, most: int = MOST_COPIES, steps: int = 80, tolerance: float = 1e-9) -> DataFrame:
    """(sid, lam): the multipliers at which the tilted rates meet the targets. cells: (sid, size, n).

    Sums are of decimals, so that they don't depend on the order of rows and reruns agree. Multipliers that
    don't settle in so many steps are an error, and give no mix off its targets.
    """
    ratio = F.log(F.col("target") / F.col("source_size")) / (F.col("low") / F.col("high"))
    state = sources.where("source_size > 0").select("sid", "target", "high", F.lit(0.0).alias("lam"), F.least(F.lit(0.0), ratio).alias("lo"), (F.log(F.lit(float(most))) / (F.col("low") / F.col("high"))).alias("hi"))
    state = materialise(state, "newton")
    for _ in range(steps):
        words = F.col("n") * F.col("size") * _rate(F.col("lam"), F.col("size"), F.col("high"), most)
        free = F.col("lam") * F.col("size") / F.col("high") < F.log(F.lit(float(most)))
        exact = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")
        sums = cells.join(state, "sid").groupBy("sid").agg(exact(words).alias("got"), exact(F.when(free, words * F.col("size") / F.col("high")).otherwise(0.0)).alias("slope"))
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap <= 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap >= 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - gap / F.nullif(F.col("slope"), F.lit(0.0))
        nxt = state.join(sums, "sid").withColumns({"lo": lo, "hi": hi, "off": F.abs(gap) / F.col("target")}).withColumn("step", step)
        good = F.col("step").isNotNull() & (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
        nxt = nxt.withColumn("lam", F.when(F.col("off") <= tolerance, F.col("lam")).when(good, F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2))
        # a source at its cap has its answer at the end of the bracket
        nxt = nxt.withColumn("lam", F.when((F.col("off") > tolerance) & (F.col("hi") - F.col("lo") <= 1e-12 * F.abs(F.col("hi"))), F.col("hi")).otherwise(F.col("lam")))
        done = materialise(nxt.select("sid", "target", "high", "lam", "lo", "hi", "off"), "newton")
        remove(state)
        state = done.drop("off")
        if not done.where((F.col("off") > tolerance) & (F.col("hi") - F.col("lo") > 1e-12 * F.abs(F.col("hi")))).limit(1).count():
            break
    else:
        raise ArithmeticError(f"the mix's multipliers didn't settle in {steps} steps")
    return state.select("sid", "lam")


def _quotas(cells: DataFrame, sources: DataFrame, lam: DataFrame, most: int, corrections: int = 5) -> DataFrame:
    """(sid, size, n, q): copies that all n documents of a source and size get together, 0 to most * n.

    Expected copies are rounded cumulatively from the longest documents down, which leaves each source off by half its
    longest document at most; then a few steps each move the copies of one size that bring the source nearest.
    """
    goal = sources.select("sid", "target", "high")
    rated = cells.join(lam, "sid").join(goal, "sid").withColumn("r", F.col("n") * _rate(F.col("lam"), F.col("size"), F.col("high"), most))
    upto = Window.partitionBy("sid").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rated.withColumn("c", F.floor(F.sum("r").over(upto) + 0.5 - 1e-9))
    q = F.col("c") - F.coalesce(F.lag("c").over(Window.partitionBy("sid").orderBy(F.col("size").desc())), F.lit(0))
    now = materialise(run.withColumn("q", F.least(F.greatest(q, F.lit(0)), F.col("n") * most)).select("sid", "size", "n", "target", "q"), "quota")
    for _ in range(corrections):
        off = now.groupBy("sid").agg((F.first("target") - F.sum(F.col("q") * F.col("size"))).alias("e"))
        joined = now.join(off, "sid")
        m = F.greatest(-F.col("q"), F.least(F.col("n") * most - F.col("q"), F.round(F.col("e") / F.col("size")).cast("long")))
        moved = joined.withColumn("m", m).withColumn("left", F.abs(F.col("e") - F.col("m") * F.col("size"))).where((F.col("m") != 0) & (F.col("left") < F.abs("e")))
        best = moved.groupBy("sid").agg(F.min(F.struct("left", "size", "m")).alias("b")).select("sid", F.col("b.size").alias("size"), F.col("b.m").alias("m"))
        nxt = materialise(now.join(best, ["sid", "size"], "left").select("sid", "size", "n", "target", (F.col("q") + F.coalesce("m", F.lit(0))).alias("q")), "quota")
        remove(now)
        now = nxt
    return now.drop("target")


def mix(docs: DataFrame, most: int = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of `docs`.

    Null texts have size 0, and documents of size 0 get no copies; a null source is a source of its own, the last.
    Which of a source's equally long documents get one copy more is decided by a hash of the id (equal ids: by row
    order within the group, all of whose rows are alike). An empty table gives an empty result.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = materialise(sized, "sized")
    rows = sized.count()
    bins = max(1, -(-rows // BIN_ROWS))
    sources = materialise(source_targets(sized, most), "sources")
    keyed = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    keyed = materialise(keyed.select("doc_id", "d.source", "size", "source_size", "target", "sid", F.xxhash64("doc_id").alias("h")).withColumn("bin", F.pmod("h", F.lit(bins)).cast("int")), "keyed")
    remove(sized)
    small = materialise(keyed.where("size > 0").groupBy("sid", "size", "bin").agg(F.count("*").alias("n")), "cells")
    cells = materialise(small.groupBy("sid", "size").agg(F.sum("n").alias("n")), "cells")
    quota = _quotas(cells, sources, solve(cells, sources, most), most)
    # a size's copies are shared out over its bins, cumulatively again
    shared = small.join(quota.select("sid", "size", F.col("n").alias("n_all"), "q"), ["sid", "size"])
    upto = Window.partitionBy("sid", "size").orderBy("bin")
    shared = shared.withColumn("c", F.expr("q * sum(n) OVER (PARTITION BY sid, size ORDER BY bin ROWS UNBOUNDED PRECEDING) div n_all"))
    shared = shared.withColumn("q", F.col("c") - F.coalesce(F.lag("c").over(upto), F.lit(0))).select("sid", "size", "bin", F.expr("q div n").alias("base"), F.expr("q % n").alias("extra"))
    ranked = keyed.withColumn("k", F.row_number().over(Window.partitionBy("sid", "size", "bin").orderBy("h", "doc_id")))
    out = ranked.join(shared, ["sid", "size", "bin"], "left")
    copies = F.coalesce(F.col("base") + F.when(F.col("k") <= F.col("extra"), 1).otherwise(0), F.lit(0)).cast("int")
    return out.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), copies.alias("copies"))


def repeat_rows(docs: DataFrame, most: int = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs`, each as many times as `mix` takes it.

    Rows that share an id, or have none, are told apart by source and size; those that agree in both share out the
    copies that the mix gives them together. All columns stay, whatever their names; an empty table stays empty.
    """
    mixed = materialise(mix(docs, most, id_col, text_col, source_col).select("doc_id", "source", "size", "copies"), "mixed")
    key, n, copies, size, rank, nth = (unused(docs.columns, c) for c in ("_id", "_n", "_copies", "_size", "_rank", "_nth"))
    per_id = materialise(mixed.groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias(n), F.max("copies").alias(copies)), "copies")
    out = docs.join(per_id.where((F.col(n) == 1) & (F.col(copies) > 0)), docs[id_col].eqNullSafe(F.col(key))).select(*columns(docs), F.col(copies))
    shared = per_id.where(F.col(n) > 1)
    if not shared.isEmpty():
        src = unused(docs.columns, "_source")
        groups = mixed.groupBy(F.col("doc_id").alias(key), F.col("source").alias(src), F.col("size").alias(size)).agg(F.count("*").alias(n), F.sum("copies").alias(copies))
        groups = groups.where((F.col(copies) > 0) & (F.col(n) > 0)).join(shared.select(F.col(key).alias(nth)), F.col(key).eqNullSafe(F.col(nth)), "left_semi")
        met = docs.join(groups, docs[id_col].eqNullSafe(F.col(key)) & docs[source_col].eqNullSafe(F.col(src)) & (word_count(docs[text_col]) == F.col(size)))
        order = Window.partitionBy(key, src, size).orderBy(F.xxhash64(docs[text_col]), docs[text_col])
        each = F.expr(f"`{copies}` div `{n}`") + F.when(F.col(rank) <= F.col(copies) % F.col(n), 1).otherwise(0)
        met = met.withColumn(rank, F.row_number().over(order)).withColumn(copies, each.cast("int")).where(F.col(copies) > 0)
        out = out.unionAll(met.select(*columns(docs), F.col(copies)))
    return out.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*columns(docs))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. Null texts have size 0 and are taken zero times; a null source is a source
    of its own, the last; an empty table gives no row."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_source_mix": op6_source_mix}
ORACLES: dict[str, str] = {}
