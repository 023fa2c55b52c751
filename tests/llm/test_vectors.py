import math

import numpy as np
import pytest

from dialex.llm import topk, vector_dedup
from dialex.llm.components import Forest, connected_components, tiles

SCHEMA = "id long, v array<float>, key long, node long"


def rows_of(seed, n=300, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((12, dim))
    v = np.concatenate([base[rng.integers(0, 12, n // 2)] + 0.08 * rng.standard_normal((n // 2, dim)), rng.standard_normal((n - n // 2, dim))]).astype(np.float32)
    v[:8] = v[0]
    rows = [(i, x.tolist(), 1, 2) for i, x in enumerate(v)]
    odd = [None, [], [0.0] * dim, [None] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] * dim, [1.0, 2.0]]
    return rows + [(1000 + i, x, 1, 2) for i, x in enumerate(odd)] + [(None, v[1].tolist(), 1, 2), (2000, [2.0 * x for x in v[3].tolist()], 1, 2)]


def good(v, zero=False):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def test_near_duplicates_against_brute_force(spark):
    rows = rows_of(1)
    links, f = {}, Forest(len(rows))
    for i, (a, v, *_) in enumerate(rows):
        for j, (b, w, *_) in enumerate(rows):
            if i != j and a is not None and b is not None and good(v) and good(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.95:
                    links[i] = links.get(i, 0) + 1
                    f.join(i, j)
    got = sorted(map(tuple, vector_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)
    assert got == sorted(((r[0], links.get(i, 0), rows[f.find(i)][0]) for i, r in enumerate(rows)), key=str)
    tiled = vector_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), tile_rows=4, window=8)
    assert sorted(map(tuple, tiled.collect()), key=str) == got


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def crowd(rng, n, dim, alike, twins):
    """n vectors at a mutual cosine of `alike`, and for `twins` of them a vector at a cosine of about 0.96."""
    v = unit(np.sqrt(alike) * unit(rng.standard_normal(dim)) + np.sqrt(1 - alike) * unit(rng.standard_normal((n, dim))))
    return np.concatenate([v, unit(v[:twins] + 0.28 * unit(rng.standard_normal((twins, dim))))])


def test_near_duplicates_in_a_crowd(spark):
    """Links among vectors that are all alike (cosine 0.9), where hashes say little: nearly all are found, none made up."""
    v = crowd(np.random.default_rng(6), 4000, 64, 0.9, 200)
    near = v @ v.T >= 0.95
    f = Forest(len(v))
    for i, j in zip(*np.nonzero(near), strict=True):
        f.join(int(i), int(j))
    got = {r.id: (r.n_links, r.component) for r in vector_dedup.near_duplicates(spark.createDataFrame(list(enumerate(v.tolist())), "id long, v array<double>")).collect()}
    right = {i: (int(near[i].sum()) - 1, f.find(i)) for i in range(len(v))}
    linked = [i for i in right if right[i][0]]
    assert len(linked) >= 200 and sum(got[i] == right[i] for i in linked) >= 0.98 * len(linked)
    assert all(got[i][0] <= right[i][0] and f.find(got[i][1]) == f.find(i) for i in right)


def test_neighbours_over_the_bounds_of_tasks(spark):
    """One pass, many ranges: each vector's twin has the same key, and none is lost at a bound."""
    rng = np.random.default_rng(2)
    v = unit(rng.standard_normal((300, 8)))
    rows = [(i, (x * (1 + i % 2)).tolist()) for i, x in enumerate(np.repeat(v, 2, axis=0))]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    got = {r.id: r.component for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "id long, v array<double>"), least=0.999999, passes=1, window=2).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert all(got[i + 1] <= got[i] <= i for i in range(0, 600, 2))


def test_rare_dimensions_go_without_a_mean(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "MEANS", 1)
    rows = [(i, [float(i % 3 == k) for k in range(3)]) for i in range(9)] + [(20, [3.0, 4.0]), (21, [6.0, 8.0]), (22, [1.0, -1.0])]
    got = {r.id: (r.n_links, r.component) for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "id long, v array<double>")).collect()}
    assert got == {i: (2, i % 3) for i in range(9)} | {20: (1, 20), 21: (1, 20), 22: (0, 22)}


def test_vectors_of_any_length(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1e300, -1e300]), (4, [5e-324, 0.0]), (5, [1.0, 0.0])]
    got = {r.id: (r.n_links, r.component) for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "id long, v array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4)}


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vector_dedup.near_duplicates(none).count() == 0
    assert vector_dedup.near_duplicates(spark.createDataFrame([(1, None, 0, 0)], SCHEMA)).first()["n_links"] == 0


@pytest.mark.parametrize(("block", "queries", "scale"), [(4096, 512, 256.0), (20, 3, 256.0), (64, 8, 3e12)])
def test_top_k_against_brute_force(spark, block, queries, scale):
    from pyspark.sql import functions as F

    rows = rows_of(2)
    ints = {i: [math.floor(scale * float(np.float64(np.float32(x)))) for x in v] for i, v, *_ in rows if i is not None and good(v, zero=True)}
    df = spark.createDataFrame(rows, SCHEMA).where(F.col("id").isNotNull() & topk.usable(F.col("v")))
    vectors = df.select("id", topk.integer_vector(F.col("v"), scale).alias("v"))
    if scale > 1e6:  # scores beyond exact doubles must still fit a long
        vectors = vectors.where("abs(v[0]) < 4e11").where(F.forall("v", lambda x: F.abs(x) < 700_000_000))
        kept = {r.id for r in vectors.select("id").collect()}
        ints = {i: v for i, v in ints.items() if i in kept}
    got = topk.search(topk.build_index(vectors, block), vectors.where("id % 5 = 0"), 5, queries).collect()
    expected = set()
    for q, v in ints.items():
        if q % 5 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ints.items() if i != q and len(w) == len(v))
            expected |= {(q, k, i, -s) for k, (s, i) in enumerate(scored[:5], 1)}
    assert {tuple(r) for r in got} == expected


def test_search_stops_early_only_on_proof():
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.integers(-9, 9, (2000, 8)), rng.integers(100, 900, (6, 8))])
    block = topk.Segments.of(v)
    q = v[[2000]]
    found, floor, used = topk.search_block(q, np.array([2000]), np.arange(len(v)), block, 5, np.array([-np.inf]))
    assert used < len(block.ends) - 1 and {i for _, i, _ in found} == set(range(2001, 2006))
    assert floor[0] == min(s for _, _, s in found)


@pytest.mark.parametrize("top", [40, 1 << 31, 1 << 58, (1 << 63) - 1])
def test_blocks_of_any_size_of_values(top):
    rng = np.random.default_rng(top % 1000)
    for _ in range(60):
        n, dim = int(rng.integers(1, 30)), int(rng.integers(1, 6))
        v = rng.integers(-top, top, (n, dim), endpoint=True) // rng.choice([1, 1, 1000, top])
        v[rng.random(n) < 0.3] = v[0]
        found, *_ = topk.search_block(v, np.arange(n), np.arange(n), topk.Segments.of(v), 3, np.full(n, -np.inf))
        right = set()
        for i in range(n):
            held = [(-max(topk.LEAST, min(topk.MOST, sum(int(a) * int(b) for a, b in zip(v[i], v[j], strict=True)))), j) for j in range(n) if j != i]
            right |= {(i, j, -s) for s, j in sorted(held)[:3]}
        assert set(found) == right  # beyond a long too, where all that is held at its limit ties


@pytest.mark.parametrize("top", [1 << 30, 1 << 40])
def test_ties_at_the_limits_across_blocks_and_shared_query_ids(spark, top):
    rng = np.random.default_rng(9)
    rows = [(i, rng.integers(-top, top, 4).tolist()) for i in range(120)] + [(0, [5, 5, 5, 5]), (0, [-7, 5, 5, 5]), (40, [top] * 4)]
    vectors = spark.createDataFrame(rows, "id long, v array<long>").repartition(4)
    asked = {i: min(v for j, v in rows if j == i) for i, _ in rows if i % 20 == 0}
    want = set()
    for i, q in asked.items():
        held = sorted((-max(topk.LEAST, min(topk.MOST, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in rows if j != i)
        want |= {(i, r, j, -s) for r, (s, j) in enumerate(held[:5], 1)}
    for held_blocks in (1, 3, None):
        got = topk.search(topk.build_index(vectors, 16), vectors.where("id % 20 = 0"), 5, 2, held_blocks).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(7, 7), (3, 0), (500, 400), (400, 450)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 0 for i in range(50)} | {500: 400, 400: 400, 450: 400}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tiles_pair_all_rows_once(spark):
    members = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 99)], "component long, node long")
    seen = {}
    for r in tiles(members, "component", 7).collect():
        seen.setdefault((r.component, r.tile_i, r.tile_j), []).append((r.node, r.side))
    pairs = []
    for (_, i, j), rows in seen.items():
        a = [n for n, s in rows if s == 0]
        b = [n for n, s in rows if s == 1]
        pairs += [tuple(sorted((x, y))) for x in a for y in b] if i != j else [(x, y) for x in a for y in a if x < y]
    assert sorted(pairs) == [(x, y) for x in range(40) for y in range(x + 1, 40)]
