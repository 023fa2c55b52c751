"""Exact removal of repeated substrings by distributed prefix doubling.

Equal substrings of `length` bytes hold the same smallest hash of their short grams, their anchor. So

1. texts are packed into batches of a few MB, a table bucketed by batch that later steps join without moving texts;
2. anchors met in two documents are found; a string with any other anchor is unique and is dropped;
3. the strings left go to the range of their anchor, as runs of consecutive starts, equal runs of a batch once. Runs
   equal in whole are one class, and a class that is alone with its anchor is settled. The rest is settled by prefix
   doubling: positions are ranked by 8 bytes, then sorted by pairs of ranks at offsets 8, 16 and so on, reranked, and
   dropped once their rank is unique; past `length` bytes, positions of one rank are equal strings. As equal strings
   share an anchor, every sort is over one range of anchors only;
4. the covered bytes go back to their batches.

All comparisons of strings are exact: hashes only say what cannot be equal and where to meet.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialex.llm.arrow_groups import runs
from dialex.llm.common import bound_arrow, materialise, new_path, partitions, shuffles_dropped, table

LENGTH, GRAM = 50, 20
BATCH_BYTES = 4 << 20
#: Consecutive starts in a run at most.
RUN = 64
#: Runs whose strings are settled at once.
AT_ONCE = 1 << 16
#: Starts of a batch that are hashed at once; bytes of runs that are ranked at once, if they have several anchors; and
#: strings of one anchor that are.
PIECE, RANKED, STRINGS = 1 << 18, 2 << 20, 1 << 17
#: Bytes of files to a range of anchors.
SHARE = 10 << 20
_BASE = 0xD6E8FEB86659FD93


def gram_hashes(b: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-byte grams, built up by doubling."""
    h = b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    have, size, k = None, 0, 1
    while True:
        if q & k:
            if have is None:
                have, size = h, k
            else:
                n = len(have) - k
                have = have[:n] * np.uint64(pow(_BASE, k, 1 << 64)) + h[size : size + n]
                size += k
        if 2 * k > q:
            break
        h = h[:-k] * np.uint64(pow(_BASE, k, 1 << 64)) + h[k:]
        k *= 2
    have = have ^ (have >> np.uint64(32))
    have *= np.uint64(_BASE)
    return have ^ (have >> np.uint64(29))


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w values that stand together."""
    k = 1
    while 2 * k <= w:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    r = w - k
    return np.minimum(h[: len(h) - r], h[r:]) if r else h


def _spots(sizes: np.ndarray, known: np.ndarray, text: np.ndarray, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch, its runs of starts in one document that have one anchor: first start, number of starts, document, and
    anchor as bucket << 32 | 32 bits. Starts where no whole string starts, or whose id is null, are in no run. Only the
    runs are kept of `PIECE` starts at a time, as a hash of every byte is many times the text."""
    found, ends = [], np.cumsum(sizes)
    upto = len(text) - length + 1
    before = (-1, np.uint64(0))
    for lo in range(0, max(upto, 0), PIECE):
        hi = min(upto, lo + PIECE)
        m = window_minima(gram_hashes(text[lo : hi + length - 1], GRAM), length - GRAM + 1)
        at = np.arange(lo, hi)
        some = np.arange(np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi - 1, "right") + 1)
        doc = np.repeat(some, np.diff(np.minimum(ends[some], hi), prepend=lo))
        doc[(at + length > ends[doc]) | ~known[doc]] = -1
        fresh = np.r_[(doc[0], m[0]) != before, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])]
        before = (doc[-1], m[-1])
        found.append((at[fresh], doc[fresh], m[fresh]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    first, doc, m = (np.concatenate(x) for x in zip(*found, strict=True))
    counts = np.diff(np.append(first, upto))
    ok = doc >= 0
    m = m[ok]
    anchor = ((m >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) << 32 | (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return first[ok], counts[ok], doc[ok], anchor


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Documents (id, text) to (batch, ids, sizes, text); null ids are kept apart by `known`."""
    base, done = TaskContext.get().partitionId() << 24, 0
    ids, raws, size = [], [], 0

    def row() -> pa.RecordBatch:
        arrays = [np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids], bool), np.array([len(r) for r in raws], np.int64)]
        return pa.RecordBatch.from_arrays([pa.array([base + done], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays], pa.array([b"".join(raws)], pa.binary())], names=["batch", "ids", "known", "sizes", "text"])

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (t or "").encode()
            if raws and size + len(raw) > most:
                yield row()
                ids, raws, size, done = [], [], 0, done + 1
            ids.append(i)
            raws.append(raw)
            size += len(raw)
    if raws:
        yield row()


def _unpack(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], bool), np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["text"], np.uint8)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _split(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, where) over sorted anchors."""
    b = keys >> 32
    starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(b)], strict=True):
        yield int(b[a]), slice(a, z)


def _anchors(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, batch, anchors): a batch's anchors, those met in several of its documents twice."""
    for r in _rows(batches):
        _, known, sizes, text = _unpack(r)
        _, _, d, k = _spots(sizes, known, text, length, buckets)
        order = np.lexsort((d, k))
        k, d = k[order], d[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        k = k[new]
        rank = np.arange(len(k)) - np.maximum.accumulate(np.where(np.r_[True, k[1:] != k[:-1]][: len(k)], np.arange(len(k)), 0))
        k = k[rank < 2]
        found = [(b, r["batch"], k[s].astype(np.uint32).tobytes()) for b, s in _split(k)]
        cols = list(zip(*found, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["bucket", "batch", "anchors"])


def repeated(values: np.ndarray) -> np.ndarray:
    """Whether each value, of 32 bits at most, stands in the array more than once."""
    order = np.sort(values.astype(np.uint64) << np.uint64(32) | np.arange(len(values), dtype=np.uint64))
    top = order >> np.uint64(32)
    same = np.r_[False, top[1:] == top[:-1]]
    out = np.zeros(len(values), bool)
    out[(order & np.uint64(0xFFFFFFFF)).astype(np.int64)] = same | np.r_[same[1:], False][: len(same)]
    return out


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, shared): of each batch and bucket, the anchors that two documents have."""
    for (bucket,), t in runs(batches, 1):
        owners, parts = t.column("batch").to_numpy(), [np.frombuffer(x, np.uint32) for x in t.column("anchors").to_pylist()]
        owner, anchor = np.repeat(np.arange(len(parts)), [len(x) for x in parts]), np.concatenate(parts)
        often = repeated(anchor)
        owner, anchor = owner[often], anchor[often]  # a batch's anchors are in order
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])][: len(anchor)]
        owner, anchor = owner[new], anchor[new].astype(np.int64) | bucket << 32
        cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])[: len(owner)]
        found = [(int(owners[owner[i]]), anchor[i:j].tobytes()) for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(owner)], strict=False)]
        cols = list(zip(*found, strict=True)) or [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], names=["batch", "shared"])


def _classes(text: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of runs that stand in `text` one after the other: one run of each class of equal ones, and each run's class."""
    span = counts + length - 1
    width = RUN + length
    cells = np.zeros((len(span), width), np.uint8)
    cells[:, 0] = counts
    cells.ravel()[np.arange(len(text)) + np.repeat(np.arange(len(span)) * width + 1 - (np.cumsum(span) - span), span)] = text
    _, rep, cls = np.unique(cells.view(f"S{width}").ravel(), return_index=True, return_inverse=True)
    return rep, cls


def _stretches(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of a text, one after the other."""
    return text[np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]


def _runs_of(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The runs of starts whose anchors are shared: (bucket, batch, anchors, counts, texts, n_text) of a batch's classes
    of equal runs, so that what many of its documents hold is sent once, and (docs, starts, which) of the runs."""
    names = ["bucket", "batch", "anchors", "docs", "starts", "which", "counts", "texts", "n_text"]
    for r in _rows(batches):
        ids, known, sizes, text = _unpack(r)
        first, counts, doc, anchor = _spots(sizes, known, text, length, buckets)
        shared = np.sort(np.concatenate([np.frombuffer(x, np.int64) for x in r["shared"]]))
        here = np.searchsorted(shared, anchor)
        ok = shared[np.minimum(here, len(shared) - 1)] == anchor
        starts, counts, doc, anchor = first[ok], counts[ok], doc[ok], anchor[ok]
        pieces = -(-counts // RUN)  # long runs are cut
        owner = np.repeat(np.arange(len(starts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, counts = starts[owner] + nth * RUN, np.minimum(RUN, counts[owner] - nth * RUN)
        order = np.argsort(anchor[owner], kind="stable")
        starts, counts, owner = starts[order], counts[order], owner[order]
        keys, docs = anchor[owner], ids[doc[owner]]
        span = counts + length - 1
        found = []
        for b, s in _split(keys):
            rep, cls = _classes(_stretches(text, starts[s], span[s]), counts[s], length)
            held = _stretches(text, starts[s][rep], span[s][rep])
            parts = (keys[s][rep].astype(np.uint32), docs[s], starts[s].astype(np.int32), cls.astype(np.int32), counts[s][rep].astype(np.uint8))
            found.append((b, r["batch"], *[x.tobytes() for x in parts], pa.compress(held.tobytes(), codec="zstd", asbytes=True), len(held)))
        cols = list(zip(*found, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[2:8]], pa.array(cols[8], pa.int64())], names=names)


def _rerank(pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of pairs of ranks, by sorting them, and how many positions have each rank."""
    _, rank, count = np.unique(pairs[0].astype(np.uint64) << np.uint64(32) | pairs[1].astype(np.uint64), return_inverse=True, return_counts=True)
    return rank, count


def equal_windows(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For starts of `length`-byte strings in `text`: a rank, the same for equal strings; -1 for those that are unique.

    Prefix doubling: ranks of 8 bytes, then of pairs of ranks at growing offsets, and last of one pair that overlaps.
    Positions that no surviving string needs are not ranked again.
    """
    out = np.full(len(starts), -1, np.int64)
    alive = np.arange(len(starts))
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    rank = np.zeros(len(text) + 1, np.int64)
    size, ranked = 8, None
    while len(alive):
        at = starts[alive]
        # offsets inside a string at which ranks of `size` bytes are needed later
        offsets = {0}
        widths = []
        w = size
        while w < length:
            widths.append(min(w, length - w))
            w = min(2 * w, length)
        for step in reversed(widths):
            offsets |= {o + step for o in offsets}
        need = np.unique(np.concatenate([at + o for o in sorted(offsets)]))
        if ranked is None:
            eight = np.zeros(len(need), np.uint64)
            for j in range(8):
                eight = eight << np.uint64(8) | padded[need + j].astype(np.uint64)
            _, new, count = np.unique(eight, return_inverse=True, return_counts=True)
        else:
            new, count = _rerank((rank[need], rank[need + ranked]))
        rank[need] = new
        if size >= length:
            shared = count[rank[at]] > 1
            out[alive[shared]] = rank[at[shared]]
            break
        # a string is unique if a part at any needed offset is
        keep = np.ones(len(alive), bool)
        for o in offsets:
            keep &= count[rank[at + o]] > 1
        alive = alive[keep]
        ranked = min(size, length - size)
        size = min(2 * size, length)
    return out


def _earliest(text: np.ndarray, first: np.ndarray, counts: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    """For all strings of the runs that start at `first` in text, one run after the other: the smallest of `low`, a number
    of each run, among the runs that hold the string. Strings are ranked by prefix doubling, of a long text about STRINGS
    at once: equal ones have one hash, which deals them."""
    base = np.cumsum(counts) - counts
    total = int(counts.sum())
    hashed = np.zeros(total, np.uint32)
    cuts = [0, *(np.flatnonzero(np.diff(base // STRINGS)) + 1).tolist(), len(counts)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if j > i:
            lo, hi = int(first[i]), int(first[j - 1] + counts[j - 1] + length - 1)
            at = np.arange(int(counts[i:j].sum())) + np.repeat(first[i:j] - lo - (base[i:j] - base[i]), counts[i:j])
            hashed[base[i] : base[i] + len(at)] = gram_hashes(text[lo:hi], length)[at] >> np.uint64(32)
    out = np.repeat(low, counts)
    parts = -(-total // STRINGS) if len(text) > 2 * RANKED else 1
    for p in range(parts):
        some = np.arange(total) if parts == 1 else np.flatnonzero(hashed % np.uint32(parts) == p)
        some = some[repeated(hashed[some])]  # a hash that no other string has says that the string is unique
        run = np.searchsorted(base, some, "right") - 1
        window = first[run] + some - base[run]
        strings = np.lib.stride_tricks.sliding_window_view(text, length)[window].ravel() if parts > 1 else text
        rank = equal_windows(strings, np.arange(len(some)) * length if parts > 1 else window, length)
        some = some[rank >= 0]
        rank = rank[rank >= 0]
        if len(some):
            best = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(best, rank, out[some])
            out[some] = best[rank]
    return out


def _covered(keys: np.ndarray, text: np.ndarray, counts: np.ndarray, which: np.ndarray, docs: np.ndarray, starts: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(member, start, length) of the covered stretches, of runs in `text` with their anchors and counts, and of the
    members' runs, documents and starts."""
    span = counts + length - 1
    first = np.cumsum(span) - span
    # classes: runs equal in length and bytes, over all batches
    rep, cls = _classes(text, counts, length)
    of = cls[which]
    low = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(low, of, docs)
    _, per_anchor, n_classes = np.unique(keys[rep], return_inverse=True, return_counts=True)
    alone = n_classes[per_anchor] == 1
    whole = np.flatnonzero(alone[of] & (docs > low[of]))
    yield whole, starts[whole], span[which[whole]]
    # the others: strings of their classes; every member of a class takes the class's strings
    open_cls = np.flatnonzero(~alone)
    if not len(open_cls):
        return
    open_cls = open_cls[np.argsort(rep[open_cls], kind="stable")]
    r = rep[open_cls]
    earliest = _earliest(text, first[r], counts[r], low[open_cls], length)
    slot = np.full(len(rep), -1, np.int64)
    slot[open_cls] = np.cumsum(counts[r]) - counts[r]
    still = np.flatnonzero(~alone[of])
    for lo in range(0, len(still), AT_ONCE):
        some = still[lo : lo + AT_ONCE]
        m = counts[which[some]]
        inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        gone = earliest[np.repeat(slot[of[some]], m) + inner] < np.repeat(docs[some], m)
        begin = gone & ((inner == 0) | ~np.r_[False, gone[:-1]])
        final = gone & ((inner == np.repeat(m, m) - 1) | ~np.r_[gone[1:], False])
        who = np.repeat(some, m)
        a, z = np.flatnonzero(begin), np.flatnonzero(final)
        yield who[a], starts[who[a]] + inner[a], z - a + length


def _cover(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(batch, starts, lengths): the stretches of each batch covered by strings that an earlier document has. The anchors
    of a range are worked off in parts whose runs have some RANKED bytes; only a single anchor may have more."""
    for _, t in runs(batches, 1):
        cat = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in t.column(name).to_pylist()])  # noqa: B023, E731
        keys, docs, starts, counts = cat("anchors", np.uint32), cat("docs", np.int64), cat("starts", np.int32), cat("counts", np.uint8)
        sizes, members = (np.array([len(x) // 4 for x in t.column(c).to_pylist()]) for c in ("anchors", "which"))
        which = cat("which", np.int32) + np.repeat(np.cumsum(sizes) - sizes, members)
        batch, owner = t.column("batch").to_numpy(), np.repeat(np.arange(len(members), dtype=np.int32), members)
        span = counts.astype(np.int64) + length - 1
        text, at = np.empty(int(span.sum()), np.uint8), 0
        for x, n in zip(t.column("texts"), t.column("n_text").to_pylist(), strict=True):
            text[at : at + n] = np.frombuffer(pa.decompress(x.as_py(), n, codec="zstd", asbytes=True), np.uint8)
            at += n
        place = np.cumsum(span) - span
        order = np.argsort(keys, kind="stable")
        held = np.cumsum(span[order])
        new = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
        cuts = new[np.r_[True, np.diff((held[new] - span[order][new]) // RANKED) > 0]]
        part = np.empty(len(keys), np.int32)
        part[order] = np.repeat(np.arange(len(cuts), dtype=np.int32), np.diff(np.append(cuts, len(keys))))
        by_member = np.argsort(part[which], kind="stable")
        bounds = np.searchsorted(part[which][by_member], np.arange(len(cuts) + 1))
        new_place = np.empty(len(keys), np.int64)
        found_owner, found_at, found_size = [], [], []
        for p, (i, j) in enumerate(zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True)):
            mine, who = np.sort(order[i:j]), by_member[bounds[p] : bounds[p + 1]]
            new_place[mine] = np.arange(len(mine))
            held_text = _stretches(text, place[mine], span[mine])
            for m, a, n in _covered(keys[mine], held_text, counts[mine].astype(np.int64), new_place[which[who]], docs[who], starts[who].astype(np.int64), length):
                found_owner.append(owner[who[m]])
                found_at.append(a.astype(np.int32))
                found_size.append(n.astype(np.int32))
        owner, at, size = (np.concatenate(x) for x in (found_owner, found_at, found_size))
        order = np.argsort(owner, kind="stable")
        owner, at, size = owner[order], at[order], size[order]
        edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(order) else np.zeros(0, int)
        found = [(int(batch[owner[i]]), at[i:j].tobytes(), size[i:j].tobytes()) for i, j in zip(edges, [*edges[1:], len(order)], strict=True)]
        cols = list(zip(*found, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["batch", "starts", "lengths"])


def _apply(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for r in _rows(batches):
        ids, known, sizes, text = _unpack(r)
        step = np.zeros(len(text) + 1, np.int32)
        for a, n in zip(r["starts"] or [], r["lengths"] or [], strict=True):
            a, n = np.frombuffer(a, np.int32), np.frombuffer(n, np.int32)
            np.add.at(step, a, 1)
            np.add.at(step, a + n, -1)
        gone = np.cumsum(step[:-1]) > 0
        rows, at = [], 0
        for i, k, n in zip(ids.tolist(), known.tolist(), sizes.tolist(), strict=True):
            g = gone[at : at + n]
            removed = int(np.count_nonzero(g))
            kept = text[at : at + n][~g].tobytes() if removed else text[at : at + n].tobytes()
            spans = int(np.count_nonzero(g & ~np.r_[False, g[:-1]])) if removed else 0
            rows.append((i if k else None, n, removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            at += n
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _ranges(docs: DataFrame) -> int:
    """Ranges of anchors: one for SHARE bytes of files where their size is known, but no fewer than the session's
    partitions, so that a task holds no more of a larger table."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(partitions(docs.sparkSession), min(-(-size // SHARE), 1 << 16) if size < 1 << 50 else 0)


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row: what is left of each text once every
    byte is removed that a `length`-byte string covers which also starts in a document with a smaller id.

    Null texts are empty. Rows with a null id keep everything and count for no other; rows with equal ids don't count
    for each other. `kept` is filled only with `keep_text`, as bytes: cuts may fall inside characters. Other columns
    aren't read; an empty table gives an empty result.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    spark = docs.sparkSession
    bound_arrow(spark)
    buckets = _ranges(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = rows.mapInArrow(partial(_pack, most=BATCH_BYTES), "batch long, ids binary, known binary, sizes binary, text binary")
    name = f"dialex_packed_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        packed.write.bucketBy(buckets, "batch").option("path", new_path(spark, "packed")).option("compression", "zstd").saveAsTable(name)
    packed = spark.table(name)
    anchors = packed.mapInArrow(partial(_anchors, length=length, buckets=buckets), "bucket int, batch long, anchors binary")
    met = anchors.repartition(buckets, "bucket").sortWithinPartitions("bucket", "batch")
    shared = met.mapInArrow(_shared, "batch long, shared binary").groupBy("batch").agg(F.collect_list("shared").alias("shared"))
    shared = materialise(shared, "shared")
    schema = "bucket int, batch long, anchors binary, docs binary, starts binary, which binary, counts binary, texts binary, n_text long"
    spread = packed.join(shared, "batch").mapInArrow(partial(_runs_of, length=length, buckets=buckets), schema)
    met = spread.repartition(buckets, "bucket").sortWithinPartitions("bucket", "batch")
    cover = met.mapInArrow(partial(_cover, length=length), "batch long, starts binary, lengths binary")
    cover = cover.groupBy("batch").agg(F.collect_list("starts").alias("starts"), F.collect_list("lengths").alias("lengths"))
    cover = materialise(cover, "cover")  # runs are the most that is shuffled: they go before the texts are cut
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return packed.join(cover, "batch", "left").mapInArrow(partial(_apply, keep_text=keep_text), out)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats of 50 bytes leave of every document. Null and empty texts have no bytes; rows without an id keep all
    of theirs and count for no other, as do rows with equal ids for each other; an empty table gives no row."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES: dict[str, str] = {}
