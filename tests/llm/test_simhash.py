import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
import xxhash

from dialex.llm import simhash as S
from dialex.llm.common import materialise
from dialex.llm.components import Forest


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(items, linked):
    f = Forest(len(items))
    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                f.join(i, j)
    return [f.find(i) for i in range(len(items))]


def test_against_brute_force(hard):
    rows = sorted(((r.doc_id, r.text) for r in hard.where("doc_id IS NOT NULL").collect()), key=str)
    rows.sort(key=lambda r: r[0])
    prints = [fingerprint(t) for _, t in rows]
    roots = components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    got = {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in S.simhash_components(hard).where("doc_id IS NOT NULL").collect()}
    assert got == {(d, p, rows[k][0]) for (d, _), p, k in zip(rows, prints, roots, strict=True)}
    assert S.simhash_components(hard).count() == hard.count()


def test_empty(empty):
    assert S.simhash_components(empty).count() == 0
    assert S.near_duplicate_groups(empty).count() == 0


@pytest.mark.parametrize("crowd", [8, 5000])
def test_no_pair_is_lost_in_crowds(spark, monkeypatch, crowd):
    monkeypatch.setattr(S, "CROWD", crowd)
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 62, 3)
    prints = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 60, (200, 3)), axis=1) for c in centre]))
    far = S.pivot_distances(prints[:, None])
    f = Forest(len(prints))
    for sample in S.key_samples(64, 2, len(prints)):
        key = next(S._key_columns(prints[:, None], [sample]))
        for k in np.unique(key):
            at = np.flatnonzero(key == k)
            for a, b in S._crowd(prints[at][:, None], far[at], 2, 64, sample, Forest(len(at))):
                f.join(int(at[a]), int(at[b]))
    assert [f.find(i) for i in range(len(prints))] == components(prints.tolist(), lambda a, b: (a ^ b).bit_count() <= 2)


def test_near_duplicates_by_jaccard(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [[word() for _ in range(300)] for _ in range(12)]
    docs = []
    for b in base:
        for edits in (0, 1, 3, 6, 30, 90):
            w = list(b)
            for _ in range(edits):
                w[rng.randrange(300)] = word()
            docs.append(" ".join(w))
    docs += [None, "", "a b", "a b", "a b c"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    sets = [set(S.shingle_hashes(S.words_of(t), 5).tolist()) for t in docs]
    roots = components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    got = {r.doc_id: r.component_id for r in S.near_duplicate_groups(df).collect()}
    assert [got.get(i, i) for i in range(len(docs))] == roots
    tiled = {r.doc_id: r.component_id for r in S.near_duplicate_groups(df, tile_rows=2).collect()}
    assert tiled == got


def test_near_duplicates_with_unequal_repeats(spark):
    """Sets decide, however often a text says the same shingle."""
    words = [f"w{i}" for i in range(212)]
    once, often = " ".join(words), " ".join(words + words[:12] * 20)
    df = spark.createDataFrame([(1, once), (2, often), (3, "other words that nobody else says here")], "doc_id long, text string")
    a, b = (set(S.shingle_hashes(S.words_of(t), 5).tolist()) for t in (once, often))
    assert len(a & b) >= 0.9 * len(a | b)
    assert {r.doc_id: r.component_id for r in S.near_duplicate_groups(df).collect()} == {1: 1, 2: 1}


def test_no_similar_pair_is_lost_at_the_threshold(spark):
    """Pairs right at 0.8 share enough keys, however many other texts there are: keys don't depend on their number."""
    rng = np.random.default_rng(4)
    for n in (60, 225, 900):
        for _ in range(200):
            h = np.unique(rng.integers(0, 1 << 63, n + n // 4, dtype=np.int64).astype(np.uint64) << np.uint64(1))
            a, b = (dict(zip(*(x.tolist() for x in S.set_keys(s, 0.8)), strict=True)) for s in (np.sort(rng.permutation(h)[: int(np.ceil(0.8 * len(h)))]), h))
            needs = [min(a[k], b[k]) for k in a.keys() & b.keys()]
            assert any(needs.count(x) >= x for x in needs)
    with pytest.raises(ValueError):
        S.key_samples(128, 28, 1000)


def test_short_near_duplicates(spark):
    """Texts of a few shingles against brute force: 4 of 5, 8 of 10 and 12 of 15 shared are similar by 0.8 exactly."""
    rng = random.Random(3)
    docs = []
    for g in range(300):
        w = [f"g{g}x{i}" for i in range(20)]
        n = rng.choice([8, 9, 12, 16, 19])
        docs += [" ".join(w[: n + k]) for k in (0, 1, 3)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    sets = [set(S.shingle_hashes(S.words_of(t), 5).tolist()) for t in docs]
    roots = components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    got = {r.doc_id: r.component_id for r in S.near_duplicate_groups(df).collect()}
    assert [got.get(i, i) for i in range(len(docs))] == roots
    found = 0
    for i in range(3000):
        h = np.unique(np.random.default_rng(i).integers(0, 1 << 63, 5, dtype=np.int64).astype(np.uint64) << np.uint64(1))
        a, b = (list(zip(*(x.tolist() for x in S.set_keys(s, 0.8)), strict=True)) for s in (h[:4], h))
        needs = [min(x, y) for k, x in a for q, y in b if k == q]
        found += any(needs.count(x) >= x for x in needs)
    assert found == 3000


def test_near_dedup_meets_by_pivots_too_and_drops_its_shuffles(spark, monkeypatch):
    """Texts whose fingerprints are within the radius are candidates by the pivots alone; what is written is left without
    shuffle files, and the session's settings are as before."""
    say = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(1, say), (2, say + " x"), (3, "quite another text of a few words only")], "doc_id long, text string")
    monkeypatch.setattr(S, "candidates", lambda texts, words, least: texts.selectExpr("node AS a", "node AS b").limit(0))
    assert {r.doc_id: r.component_id for r in S.near_duplicate_groups(df).collect()} == {1: 1, 2: 1}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    left = lambda: {f.name for d in dirs for f in Path(d).glob("*/shuffle_*")}
    had = left()
    materialise(spark.range(10_000).repartition(3).groupBy("id").count().repartition(2, "count"), "shuffled")
    for _ in range(50):
        if left() <= had:
            break
        time.sleep(0.1)
    assert left() <= had and spark.conf.get(key, None) == before


def test_large_components_of_candidates_are_split_before_sets_are_copied(spark, monkeypatch):
    """Candidates that tie everything give one component; only sets whose sketches are alike are copied for its blocks,
    and the groups are those of brute force."""
    rng = random.Random(8)
    say = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    texts = [say(rng.randint(3, 400)) for _ in range(60)]
    for b in range(0, 40, 4):
        for edits in (1, 3, 8):
            w = list(texts[b])
            for _ in range(edits):
                w[rng.randrange(len(w))] = "new"
            texts.append(w)
    docs = [*map(" ".join, texts), "", " "]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    sets = [np.unique(S.shingle_hashes(S.words_of(t), 5)) for t in docs]
    roots = components([set(x.tolist()) for x in sets], lambda a, b: len(a & b) >= 0.8 * len(a | b))
    for a, b in zip(sets, sets[1:], strict=False):
        wide, narrow = sorted((S.sketch(a), S.sketch(b)), key=len, reverse=True)
        wide = np.bitwise_xor.reduce(wide.reshape(-1, len(narrow)), axis=0)
        assert np.bitwise_count(wide ^ narrow).sum() <= len(np.setxor1d(a, b))

    monkeypatch.setattr(S, "candidates", lambda texts, words, least: texts.selectExpr("node AS a", "min(node) OVER () AS b"))
    monkeypatch.setattr(S, "SKETCHED", 16, raising=False)
    dealt, tiles = [], S.tiles

    def counted(members, component, rows):
        out = tiles(members, component, rows)
        dealt.append((rows, out.count()))
        return out

    monkeypatch.setattr(S, "tiles", counted)
    got = {r.doc_id: r.component_id for r in S.near_duplicate_groups(df, tile_rows=8).collect()}
    assert [got.get(i, i) for i in range(len(docs))] == roots
    assert sum(n for rows, n in dealt if rows == 8) <= len(docs)
