"""SimHash near-duplicates with pivot distance tables.

A text's shingles vote on the bits of a fingerprint. For every distinct fingerprint the Hamming distances to a set of
reference fingerprints, the pivots, are computed once. Two fingerprints whose distances to any pivot differ by more than
the radius are further apart than the radius, so a pair is discarded by its largest coordinate difference, and only
survivors are compared bit by bit.

Which pairs meet at all: fingerprints that agree in two of a few more blocks than the radius can spoil, so that no link
can be lost. Groups that meet are sorted by their distance to the first pivot, so that a fingerprint is compared within
a band. Of each group's links only a spanning forest is passed on.

The pipeline's near-dedup links texts by the Jaccard similarity of their shingle sets. Its candidates are what the pivots
leave of the fingerprints and, as sets that are similar may have fingerprints further apart, sets that share blocks of
the sets themselves, again so that no link can be lost, whatever the number of texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialex.llm.arrow_groups import runs
from dialex.llm.common import bound_arrow, materialise, new_path, partitions, shuffles_dropped, table
from dialex.llm.components import Forest, connected_components, tiles

PIVOTS, SEED = 8, 7
#: Blocks of a 64-bit fingerprint; links of up to BLOCKS - 2 differing bits agree in two blocks.
BLOCKS = 4
#: Fingerprints that meet under one key: groups up to FEW are compared together with others, groups over CROWD are
#: split by further bits.
FEW, CROWD = 48, 4096
#: Pairs compared at once in a task.
PAIRS = 1 << 20
#: Blocks of a class of sets for each element in which sets that link can differ: spare ones, as some blocks stay empty.
SPARE = 1.3
#: Texts whose keys are sent on together.
TEXTS = 256
#: Nodes under one key that are compared pair by pair.
TOGETHER = 16
#: Keys that sets must share to be candidates, where so many are sure to be shared.
SHARED = 4
#: Bits of a key below its sample's number.
KEY_BITS = 40
#: Rows of a block of a large component whose sketches are compared in a task, and words of sketches compared at once.
SKETCHED, WORDS = 2048, 1 << 21


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space, as UTF-8."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 (seed 42) of the n-word shingles, repeats included; a shorter text is one shingle, an empty one none."""
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([h(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    return np.array([h(joined[a:b], 42) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """The 64-bit word whose bits are those set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(h), bitorder="little").tobytes(), "little")


def remix(h: np.ndarray) -> np.ndarray:
    """Further 64 bits of a hash, for longer fingerprints."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _fingerprints(batches: Iterator[pa.RecordBatch], n: int, lanes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for t in batch.column(batch.num_columns - 1).to_pylist():
            h = shingle_hashes(words_of(t), n)
            row = []
            for _ in range(lanes):
                row.append(majority(h) - (1 << 63) ^ -(1 << 63))
                h = remix(h)
            out.append(row)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): for every row of docs, the fingerprint in words of 64 bits (as signed longs)."""
    bound_arrow(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_fingerprints, n=words, lanes=lanes), "doc_id long, fp array<long>")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")


def _key_columns(fp: np.ndarray, samples: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each sample of bit positions, those bits as a number."""
    bits = _bits(fp)
    for s in samples:
        yield bits[:, s].astype(np.int64) @ (np.int64(1) << np.arange(len(s), dtype=np.int64))


def key_samples(width: int, radius: int, rows: int) -> list[np.ndarray]:
    """The sets of bits on which fingerprints meet, the same for any number of rows: pairs of blocks, as every link of
    up to BLOCKS - 2 differing bits agrees in one of them."""
    if radius > BLOCKS - 2:
        raise ValueError(f"radius must be at most {BLOCKS - 2}")
    blocks = np.array_split(np.arange(width), BLOCKS)
    return [np.concatenate(c) for c in combinations(blocks, 2)]


def pivot_distances(fp: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to the pivots."""
    pivots = np.random.default_rng([SEED, fp.shape[1]]).integers(0, 1 << 63, (PIVOTS, fp.shape[1]), dtype=np.int64) * 2 + np.random.default_rng(SEED).integers(0, 2, (PIVOTS, fp.shape[1]))
    return np.stack([np.bitwise_count((fp ^ p).view(np.uint64)).sum(axis=1).astype(np.uint8) for p in pivots], axis=1)


def _keyed(batches: Iterator[pa.RecordBatch], samples: list[np.ndarray], lanes: int) -> Iterator[pa.RecordBatch]:
    """(key, node, far, f0, ...) for each sample of bits: key holds the sample's number and its bits, far the eight
    distances to the pivots, a byte each."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fp = batch.column(1).flatten().to_numpy().reshape(n, -1)
        rest = [batch.column(0), pa.array(pivot_distances(fp).view(np.int64).ravel()), *[pa.array(np.ascontiguousarray(fp[:, i])) for i in range(lanes)]]
        for k, key in enumerate(_key_columns(fp, samples)):
            yield pa.RecordBatch.from_arrays([pa.array(key | k << KEY_BITS), *rest], names=["key", "node", "far", *[f"f{i}" for i in range(lanes)]])


def _near(fp: np.ndarray, far: np.ndarray, counts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each row and the counts[row] rows after it, the pairs at most `radius` bits apart: discarded by the pivots one
    after the other, then verified. So many pairs at once that memory is bounded."""
    done = np.cumsum(counts)
    at = 0
    while at < len(counts):
        upto = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
        c = counts[at:upto]
        i = np.repeat(np.arange(at, upto), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        for p in range(far.shape[1]):
            ok = np.abs(far[i, p] - far[j, p]) <= radius
            i, j = i[ok], j[ok]
            if not len(i):
                break
        near = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)).sum(axis=1) <= radius
        if near.any():
            yield i[near], j[near]
        at = upto


def links_within(fp: np.ndarray, far: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows at most `radius` bits apart, looked for within the band of the first pivot."""
    order = np.argsort(far[:, 0], kind="stable")
    fp, far = fp[order], far[order].astype(np.int16)
    ends = np.searchsorted(far[:, 0], far[:, 0] + radius, "right")
    for i, j in _near(fp, far, ends - np.arange(len(fp)) - 1, radius):
        yield order[i], order[j]


def _crowd(fp: np.ndarray, far: np.ndarray, radius: int, width: int, used: np.ndarray, forest: Forest) -> list[tuple[int, int]]:
    """A spanning forest of the links of a group; a large group is split by pairs of blocks of the bits that its key
    leaves open, which loses no link within a radius of BLOCKS - 2."""
    out = []
    open_bits = np.setdiff1d(np.arange(width), used)
    if len(fp) > CROWD and radius <= BLOCKS - 2 and len(open_bits) >= BLOCKS:
        blocks = np.array_split(open_bits, BLOCKS)
        for pair in combinations(blocks, 2):
            s = np.concatenate(pair)
            key = next(_key_columns(fp, [s]))
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    inner = _crowd(fp[part], far[part], radius, width, np.union1d(used, s), Forest(len(part)))
                    out += [(int(part[a]), int(part[b])) for a, b in inner if forest.join(int(part[a]), int(part[b]))]
        return out
    for i, j in links_within(fp, far, radius):
        out += [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if forest.join(a, b)]
    return out


def _meet(batches: Iterator[pa.RecordBatch], radius: int, lanes: int, samples: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for t in _crowds(batches):
        if not t.num_rows:
            continue
        key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
        far = np.ascontiguousarray(t.column("far").to_numpy()).view(np.uint8).reshape(t.num_rows, PIVOTS)
        fp = np.stack([t.column(f"f{i}").to_numpy() for i in range(lanes)], axis=1)
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, len(key))
        sizes = ends - starts
        small = np.repeat(sizes <= FEW, sizes)
        counts = np.where(small, np.repeat(ends, sizes) - np.arange(len(key)) - 1, 0)
        forest, a, b = Forest(len(key)), [], []
        for i, j in _near(fp, far.astype(np.int16), counts, radius):  # groups of a few, all at once
            pairs = np.array([(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.join(x, y)], np.int64).reshape(-1, 2)
            a.append(node[pairs[:, 0]])
            b.append(node[pairs[:, 1]])
        for g in np.flatnonzero(sizes > FEW):
            lo, hi = starts[g], ends[g]
            pairs = np.array(_crowd(fp[lo:hi], far[lo:hi], radius, 64 * lanes, samples[key[lo] >> KEY_BITS], Forest(hi - lo)), np.int64).reshape(-1, 2)
            a.append(node[lo + pairs[:, 0]])
            b.append(node[lo + pairs[:, 1]])
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by key, without those that are alone, cut only between keys."""
    held: list[pa.RecordBatch] = []

    def shared(t: pa.Table) -> pa.Table:
        key = t.column("key").to_numpy()
        same = key[1:] == key[:-1]
        return t.filter(pa.array(np.r_[False, same] | np.r_[same, False]))

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        change = np.flatnonzero(key[1:] != key[:-1]) + 1
        if held and held[-1].column(0)[-1].as_py() != key[0]:
            yield shared(pa.Table.from_batches(held))
            held = []
        if len(change):
            held.append(batch.slice(0, int(change[-1])))
            yield shared(pa.Table.from_batches(held))
            held = [batch.slice(int(change[-1]))]
        else:
            held.append(batch)
    if held:
        yield shared(pa.Table.from_batches(held))


def near_pairs(nodes: DataFrame, radius: int, lanes: int) -> DataFrame:
    """(a, b): a spanning forest, group by group, of the links among rows (node, fp) of distinct fingerprints."""
    samples = key_samples(64 * lanes, radius, nodes.count())
    schema = "key long, node long, far long, " + ", ".join(f"f{i} long" for i in range(lanes))
    keyed = nodes.mapInArrow(partial(_keyed, samples=samples, lanes=lanes), schema)
    met = keyed.repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(partial(_meet, radius=radius, lanes=lanes, samples=samples), "a long, b long").distinct()


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row: fp as a signed long, and the smallest id reachable by links of at most
    `radius` differing bits (up to BLOCKS - 2, so that no link is lost).

    Null and empty texts have fingerprint zero, which links like any other. Rows without an id get the component of
    their fingerprint, null if no row with an id is in it; equal rows are in one component.
    """
    if radius > BLOCKS - 2:
        raise ValueError(f"radius must be at most {BLOCKS - 2}")
    prints = materialise(fingerprints(docs, words, 1, id_col, text_col), "prints")
    nodes = materialise(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")).select("node", "fp"), "nodes")
    comps = connected_components(materialise(near_pairs(nodes, radius, 1), "pairs"))
    known = nodes.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(known, "fp", "left").select("doc_id", F.col("fp")[0].alias("fp"), "component_id")


def _shingle_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingle_hashes(words_of(t), n)).view(np.int64).tobytes() for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], names=[*batch.schema.names[:-1], "shingles"])


def size_classes(upto: int, least: float) -> list[int]:
    """Where classes of set sizes start, up to the one of `upto`: sizes in a class differ by a factor of 1 / least at most."""
    starts = [1]
    while starts[-1] <= upto:
        starts.append(int(starts[-1] / least + 1e-9) + 1)
    return starts


def set_keys(h: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a sorted set of hashes, and with each how many a pair must share: as many as the smaller of its two numbers
    under one number, which every two sets with a Jaccard similarity of `least` or more do.

    Such sets differ in at most (1 - least) / (1 + least) of their sizes' sum, d elements, and their sizes by a factor
    of 1 / least. A pair meets in the class of its smaller size, so a set has keys in every class that a partner no
    larger than itself can have. A class deals hashes into blocks, and a key is what one block that isn't empty holds.
    As d differing elements spoil d blocks at most, a set shares all its keys but d with each partner; of the smallest
    d + j keys of either, the j smallest shared ones are left. Sets of a few elements may fill no more than d blocks; two
    such have the smallest of the hashes that they share among the first n - least * n + 1 of either.
    """
    n = len(h)
    if not n:
        return np.zeros(1, np.int64), np.ones(1, np.int8)
    apart = (1 - least) / (1 + least)
    starts = size_classes(n, least)
    mixed, keys, needs = remix(h), [], []
    for c in range(int(np.searchsorted(starts, max(1, np.ceil(least * n - 1e-9)), "right")) - 1, len(starts) - 1):
        last = starts[c + 1] - 1
        most = int((last + int(last / least + 1e-9)) * apart + 1e-9)
        blocks = int(np.ceil(SPARE * most)) + 2 if most else 1
        of = (h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
        at = np.flatnonzero(np.diff(of, prepend=np.uint64(blocks)))
        key = np.sort(remix(np.bitwise_xor.reduceat(mixed, at) + remix(of[at] + np.uint64(c + 1 << 33))))
        d = int((n + (int(n / least + 1e-9) if n <= last else last)) * apart + 1e-9)
        if len(key) <= d:  # a partner that fills more blocks decides how many; one that doesn't shares an early hash
            early = remix(mixed[: n - int(np.ceil(least * n - 1e-9)) + 1] + np.uint64(c + 1))
            keys += [key, early]
            needs += [np.full(len(key), 127, np.int8), np.ones(len(early), np.int8)]
            continue
        need = min(SHARED, len(key) - d)
        keys.append(key[: d + need])
        needs.append(np.full(len(keys[-1]), need, np.int8))
    return np.concatenate(keys).view(np.int64), np.concatenate(needs)


def _set_keys(batches: Iterator[pa.RecordBatch], n: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, TEXTS):
            part = batch.slice(lo, TEXTS)
            keys, needs = zip(*(set_keys(np.unique(shingle_hashes(words_of(t), n)), least) for t in part.column(1).to_pylist()), strict=True)
            node = np.repeat(part.column(0).to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(node), pa.array(np.concatenate(needs))], names=["key", "node", "need"])


def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, need) for the pairs of nodes under each key, from rows sorted by key and node. Under a key with over
    TOGETHER nodes all are tied to the first, whatever else they share."""
    for t in _crowds(batches):
        if not t.num_rows:
            continue
        key, node, need = (t.column(c).to_numpy() for c in ("key", "node", "need"))
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        first, few = np.repeat(starts, sizes), np.repeat(sizes <= TOGETHER, sizes)
        left = np.where(few, np.repeat(starts + sizes, sizes) - np.arange(len(key)) - 1, 0)
        crowd = np.flatnonzero(~few)
        met = [(node[first[crowd]], node[crowd], np.ones(len(crowd), np.int8))]
        for step in range(1, int(left.max()) + 1):
            i = np.flatnonzero(left >= step)
            met.append((node[i], node[i + step], np.minimum(need[i], need[i + step])))
        a, b, least = (np.concatenate(x) for x in zip(*met, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b]), pa.array(least[a != b])], names=["a", "b", "need"])


def candidates(texts: DataFrame, words: int, least: float) -> DataFrame:
    """(a, b): links that join, if not always directly, all rows of texts(node, text) whose sets are similar by `least`."""
    keyed = texts.mapInArrow(partial(_set_keys, n=words, least=least), "key long, node long, need byte")
    met = keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_sharing, "a long, b long, need byte")
    return met.groupBy("a", "b", "need").agg(F.count("*").alias("n")).where("n >= need").select("a", "b").distinct()


def jaccard_links(sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Pairs of sets with a Jaccard similarity of `least` or more, compared by products of 0/1 matrices, a stretch of
    elements at a time."""
    sizes = np.array([len(s) for s in sets], np.float64)
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if common >= least * (sizes.sum() - common):
            yield 0, 1
        return
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    often = np.flatnonzero(counts > 1)
    place = np.full(len(values), -1, np.int64)
    place[often] = np.arange(len(often))
    at, owner = place[at][place[at] >= 0], owner[place[at] >= 0]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    common = np.zeros((len(sets), len(sets)))
    for lo in range(0, len(often), 4096):
        a, b = np.searchsorted(at, [lo, lo + 4096])
        m = np.zeros((len(sets), min(4096, len(often) - lo)), np.float32)
        m[owner[a:b], at[a:b] - lo] = 1
        common += m @ m.T
    i, j = np.nonzero(np.triu(common >= least * (sizes[:, None] + sizes[None, :] - common), 1))
    yield from zip(i.tolist(), j.tolist(), strict=True)


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for _, t in runs(batches, 3):
        node = t.column("node").to_numpy()
        if len(node) < 2:
            continue
        forest = Forest(len(node))
        found = [(node[i], node[j]) for i, j in jaccard_links([np.frombuffer(s, np.int64) for s in t.column("shingles").to_pylist()], least) if forest.join(i, j)]
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of a set of hashes, two to four bits an element: a bit says whether an odd number of elements falls on
    it. Sketches of one length differ in no more bits than their sets in elements, and the halves of a sketch, one on
    the other, are the sketch of half the length."""
    width = max(64, 1 << (2 * len(h) - 1).bit_length())
    odd = np.bincount((remix(h) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _nearest_forest(rows: int, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of rows the least that tie what they tie, the nearest ones."""
    forest, found, nodes = Forest(rows), [], len(np.unique(np.concatenate([a, b])))
    for k in np.argsort(far, kind="stable").tolist():
        if forest.join(int(a[k]), int(b[k])):
            found.append(k)
            if len(found) == nodes - 1:
                break
    return a[found], b[found], far[found]


def sketched_pairs(sizes: np.ndarray, sketches: list[np.ndarray], least: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, of the nearest pairs, of all pairs of sets whose sizes and sketches don't rule out a Jaccard
    similarity of `least`; with `side`, of those from different sides only. No pair that links is ruled out."""
    apart = (1 - least) / (1 + least)
    order = np.argsort(sizes, kind="stable")
    n, words = sizes[order], np.array([len(sketches[i]) for i in order])
    met, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
    for width in np.unique(words):
        lo, hi = np.searchsorted(words, [width, width + 1])
        upto = int(np.searchsorted(n, n[hi - 1] / least + 1e-6, "right"))  # of these widths or twice as wide
        z = np.stack([np.bitwise_xor.reduce(sketches[i].reshape(-1, width), axis=0) for i in order[lo:upto]])
        at = 0
        while at < hi - lo:
            z_end = int(np.searchsorted(n, n[lo + at] / least + 1e-6, "right")) - lo
            step = max(1, min(hi - lo - at, WORDS // (int(width) * (z_end - at))))
            z_end = int(np.searchsorted(n, n[lo + at + step - 1] / least + 1e-6, "right")) - lo
            far = np.bitwise_count(z[at : at + step, None] ^ z[None, at:z_end]).sum(axis=2, dtype=np.int64)
            total = n[lo + at : lo + at + step, None] + n[None, lo + at : lo + z_end]
            ok = (far <= apart * total + 1e-6) & (np.arange(z_end - at)[None] > np.arange(step)[:, None])
            if side is not None:
                ok &= side[order[lo + at : lo + at + step], None] != side[order[lo + at : lo + z_end]][None]
            i, j = np.nonzero(ok)
            met.append((order[lo + at + i], order[lo + at + j], far[i, j] / np.maximum(total[i, j], 1)))
            held, at = held + len(i), at + step
            if held > PAIRS:
                met = [_nearest_forest(len(n), *(np.concatenate(x) for x in zip(*met, strict=True)))]
                held = len(met[0][0])
    return _nearest_forest(len(n), *(np.concatenate(x) for x in zip(*met, strict=True)))[:2]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(s, np.uint64) for s in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())], names=["component", "node", "n", "sketch"])


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for (_, i, j), t in runs(batches, 3):
        node, side = t.column("node").to_numpy(), t.column("side").to_numpy()
        a, b = sketched_pairs(t.column("n").to_numpy(), [np.frombuffer(s, np.uint64) for s in t.column("sketch").to_pylist()], least, side if i != j else None)
        yield pa.RecordBatch.from_arrays([pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64())], names=["a", "b"])


def split_large(sets: DataFrame, least: float, tile_rows: int) -> DataFrame:
    """sets(component, node, shingles) with components of over `tile_rows` rows split into those of the pairs that their
    sketches leave; rows without such a pair go. Candidates tie what shares a common passage into components that grow
    faster than the texts, and each of their sets would be copied for every block of rows: sketches are a sixteenth as
    large or less, and meet in far larger blocks."""
    large = materialise(sets.groupBy("component").count().where(F.col("count") > tile_rows).select("component"), "large")
    if large.isEmpty():
        return sets
    many = sets.join(F.broadcast(large), "component", "left_semi")
    sketches = materialise(many.select("component", "node", "shingles").mapInArrow(_sketches, "component long, node long, n long, sketch binary"), "sketches")
    dealt = tiles(sketches, "component", SKETCHED).select("component", "tile_i", "tile_j", "node", "side", "n", "sketch")
    met = dealt.repartition("component", "tile_i", "tile_j").sortWithinPartitions("component", "tile_i", "tile_j")
    finer = connected_components(materialise(met.mapInArrow(partial(_alike, least=least), "a long, b long"), "alike"))
    left = materialise(many.select("node", "shingles").join(finer, "node").select("component", "node", "shingles"), "sets")
    return sets.join(F.broadcast(large), "component", "left_anti").select("component", "node", "shingles").unionAll(left)


def laid_by_text(docs: DataFrame, same: str = "same") -> DataFrame:
    """docs with the MD5 of the text as column `same`, in a table bucketed by id and text: texts are shuffled once, and
    joins on both columns leave them where they are."""
    spark = docs.sparkSession
    buckets, name = partitions(spark), f"dialex_laid_{uuid.uuid4().hex}"
    keyed = docs.withColumn(same, F.md5(F.coalesce("text", F.lit("")))).repartition(buckets, "doc_id", same)
    with shuffles_dropped(spark):
        keyed.write.bucketBy(buckets, "doc_id", same).option("path", new_path(spark, "laid")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def near_duplicate_groups(docs: DataFrame, words: int = 5, least: float = 0.8, tile_rows: int = 256, same: str | None = None) -> DataFrame:
    """(doc_id, same, component_id, kept) for rows of docs(doc_id, text) that have a near duplicate: same is the MD5 of
    the text, component_id the smallest id of the group.

    Texts link if the sets of their `words`-word shingles have a Jaccard similarity of `least` or more. Candidates are
    texts whose fingerprints the pivots leave within BLOCKS - 2 bits, and sets that share enough of their `set_keys`, as
    every pair that links does, however far apart its fingerprints. Large components of candidates are split by sketches of
    the sets, which lose no link, and components are then compared exactly, tile by tile. Equal texts are one node, which has a number of its own: rows that share an id but not the
    text are told apart. Of a group the text that the smallest id holds is kept, where that id holds it (of several, the
    one with the smallest MD5); rows that agree in id and text are kept or not alike. Rows without an id are left out.
    `same` is the MD5's column where docs come from `laid_by_text`; others are laid so first.
    """
    bound_arrow(docs.sparkSession)
    docs = docs if same else laid_by_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(same or "same").alias("same"), "text")
    prints = rows.mapInArrow(partial(_fingerprints, n=words, lanes=1), "doc_id long, same string, fp array<long>")
    copies = prints.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("fp").alias("fp"))
    copies = materialise(copies.withColumn("node", F.monotonically_increasing_id()), "copies")
    nodes = materialise(copies.groupBy("fp").agg(F.min("node").alias("node")).select("node", "fp"), "nodes")
    equal = copies.select("fp", F.col("node").alias("a")).join(nodes.withColumnRenamed("node", "b"), "fp").where("a <> b").select("a", "b")
    firsts = rows.join(copies.select(F.col("first").alias("doc_id"), "same", "node"), ["doc_id", "same"]).select("node", "text")
    met = near_pairs(nodes, BLOCKS - 2, 1).unionAll(equal).unionAll(candidates(firsts, words, least))
    comps = connected_components(materialise(met, "pairs"))
    inside = materialise(copies.join(comps, "node").select(F.col("first").alias("doc_id"), "same", "component", "node"), "inside")
    members = rows.join(inside, ["doc_id", "same"]).select("component", "node", "text")
    sets = members.mapInArrow(partial(_shingle_sets, n=words), "component long, node long, shingles binary")
    sets = split_large(materialise(sets, "sets"), least, tile_rows)
    dealt = tiles(sets, "component", tile_rows).select("component", "tile_i", "tile_j", "node", "shingles")
    met = dealt.repartition("component", "tile_i", "tile_j").sortWithinPartitions("component", "tile_i", "tile_j")
    linked = connected_components(materialise(met.mapInArrow(partial(_verify, least=least), "a long, b long"), "links"))
    known = copies.join(linked, "node", "left").where("component IS NOT NULL OR n > 1")
    known = materialise(known.select("same", "first", F.coalesce("component", "node").alias("group")), "groups")
    leads = known.groupBy("group").agg(F.min(F.struct("first", "same")).alias("lead"))
    named = known.join(leads, "group").select("same", F.col("lead.first").alias("component_id"), F.col("lead.same").alias("_lead"))
    found = rows.select("doc_id", "same").join(named, "same")
    return found.select("doc_id", "same", "component_id", ((F.col("same") == F.col("_lead")) & (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def op3_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and groups of all documents. Null and empty texts have fingerprint zero, which links like any other;
    rows without an id get the group of their fingerprint, null if it has none; an empty table gives no row."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_simhash_near_dup": op3_simhash_near_dup}
ORACLES: dict[str, str] = {}
