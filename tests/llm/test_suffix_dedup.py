import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from dialex.llm import suffix_dedup
from dialex.llm.suffix_dedup import equal_windows, gram_hashes, remove_repeats, window_minima


def brute(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, r in raws:
        if i is not None:
            for p in range(len(r) - length + 1):
                first[r[p : p + length]] = min(first.get(r[p : p + length], i), i)
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1 if i is not None else 0):
            if first[r[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [21, 50, 64])
def test_against_brute_force(hard, length):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    got = sorted((tuple(r)[:5] for r in remove_repeats(hard, length).collect()), key=str)
    assert got == brute(rows, length)


def test_random_overlaps(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab c") for _ in range(300)) for _ in range(5)]
    rows = [(k, "".join(rng.choice(base)[rng.randint(0, 99) : rng.randint(110, 300)] if rng.random() < 0.6 else "é" * rng.randint(0, 40) for _ in range(rng.randint(0, 6)))) for k in range(60)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows, 50)


def test_empty_and_kept_bytes(spark, empty):
    assert remove_repeats(empty).count() == 0
    long = "0123456789" * 3 + "abcdefghijklmnopqrstuvwxyz"
    df = spark.createDataFrame([(1, long), (2, "x" + long + "y")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in remove_repeats(df, keep_text=True).collect()} == {1: long.encode(), 2: b"xy"}


def test_prefix_doubling_and_minima():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 2000).astype(np.uint8)
    for length in (9, 16, 20, 33, 50):
        starts = np.arange(len(text) - length)
        ranks = equal_windows(text, starts, length)
        seen = {}
        for s, r in zip(starts, ranks, strict=True):
            seen.setdefault(text[s : s + length].tobytes(), []).append(r)
        assert all((v == [-1]) if len(v) == 1 else (len(set(v)) == 1 and v[0] >= 0) for v in seen.values())
    h = gram_hashes(text, 7)
    assert len(h) == len(text) - 6 and len({text[i : i + 7].tobytes() for i in range(len(h))}) == len(np.unique(h))
    assert window_minima(h, 5).tolist() == [h[i : i + 5].min() for i in range(len(h) - 4)]


@pytest.mark.parametrize("at_once", [1, 7, 1 << 16])
def test_runs_that_many_documents_of_a_batch_hold(monkeypatch, at_once):
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", at_once)
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot, near = word(200), word(90)
    rows = [(i, word(rng.randint(0, 40)) + hot[rng.choice([0, 0, 13]) :] + word(20) + near[: rng.randint(50, 90)]) for i in range(60)]
    length, buckets = 50, 3

    def packed(b, part):
        raws = [t.encode() for _, t in part]
        cols = [np.array([i for i, _ in part]), np.ones(len(part), bool), np.array([len(r) for r in raws])]
        return {"batch": b, "ids": cols[0].tobytes(), "known": cols[1].tobytes(), "sizes": cols[2].tobytes(), "text": b"".join(raws)}

    def sorted_by(batches, keys):
        t = pa.Table.from_batches(list(batches)).sort_by([(k, "ascending") for k in keys])
        return t.combine_chunks().to_batches()

    batches = [packed(0, rows[1::2]), packed(1, rows[::2])]
    found = sorted_by(suffix_dedup._anchors(iter([pa.RecordBatch.from_pylist(batches)]), length, buckets), ["bucket", "batch"])
    shared = pa.Table.from_batches(list(suffix_dedup._shared(iter(found)))).to_pylist()
    full = [b | {"shared": [s["shared"] for s in shared if s["batch"] == b["batch"]]} for b in batches]
    runs = sorted_by(suffix_dedup._runs_of(iter([pa.RecordBatch.from_pylist(full)]), length, buckets), ["bucket", "batch"])
    cover = pa.Table.from_batches(list(suffix_dedup._cover(iter(runs), length))).to_pylist()
    pieces = lambda b, c: [x[c] for x in cover if x["batch"] == b["batch"]]
    done = [b | {"starts": pieces(b, "starts"), "lengths": pieces(b, "lengths")} for b in batches]
    got = pa.Table.from_batches(list(suffix_dedup._apply(iter([pa.RecordBatch.from_pylist(done)]), False))).to_pylist()
    assert sorted((tuple(r.values())[:5] for r in got), key=str) == brute(rows, length)
    kept = sum(len(x) // 4 for t in runs for x in t.column("anchors").to_pylist())
    assert kept < sum(len(x) // 4 for t in runs for x in t.column("which").to_pylist()) / 2


@pytest.mark.parametrize(("piece", "ranked", "strings"), [(64, 1, 5), (1, 200, 1), (97, 1 << 20, 1 << 17)])
def test_pieces_and_parts_of_any_size(monkeypatch, piece, ranked, strings):
    for name, value in (("PIECE", piece), ("RANKED", ranked), ("STRINGS", strings)):
        monkeypatch.setattr(suffix_dedup, name, value, raising=False)
    test_runs_that_many_documents_of_a_batch_hold(monkeypatch, 7)


def test_memory_of_a_batch_and_ranges_by_size(spark, monkeypatch):
    """A batch of 4 MB is hashed piece by piece, and ranges of anchors grow with the files, not with the session's settings."""
    sizes = np.full(4000, 1000)
    text = np.random.default_rng(2).integers(97, 123, int(sizes.sum())).astype(np.uint8)
    row = {"batch": 0, "ids": np.arange(4000).tobytes(), "known": np.ones(4000, bool).tobytes(), "sizes": sizes.tobytes(), "text": text.tobytes()}
    batch = pa.RecordBatch.from_pylist([row])
    tracemalloc.start()
    list(suffix_dedup._anchors(iter([batch]), 50, 3))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert suffix_dedup._ranges(docs) == 4
    monkeypatch.setattr(suffix_dedup, "SHARE", 1000)
    assert suffix_dedup._ranges(docs) > 4
