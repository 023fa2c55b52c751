"""Packing of token ids into sequences of at most a fixed length, by Karmarkar-Karp multiway differencing.

A document longer than a window gives whole windows and a remainder. Remainders are gathered into groups worth a few
windows, and multiway differencing deals each group, uncut, into near-equal windows: the two partial partitions of
largest spread are merged, heaviest part against lightest, until one is left. Whenever the heaviest window is over its
capacity, the count of windows rises and the group is dealt anew. The room that is left is then filled with cuts of the
lightest window, and what is left of that one goes on to the next group. Each task packs what it reads, so nothing is
shuffled.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialex.llm.common import bound_arrow, table
from dialex.llm.tokens import by_bytes, load

#: Windows' worth of remainders in a group, and words in one call or one string for the tokenizer.
GROUP_WINDOWS = 16
JOINED = 500
#: Lower-case letters of Latin-1: neither normalisation nor splitting by classes of characters changes a word of them.
PLAIN = "a-z\u00df-\u00f6\u00f8-\u00ff"
#: A word that ends in ASCII punctuation, with no apostrophe in that end.
ENDED = f"^(.*[{PLAIN}0-9])([!-&(-/:;=?@\\[-`~]+)$"
SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of `flat` that start at `first` and are `size` long, one after the other."""
    ends = np.cumsum(size)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)]


class IdEncoder:
    """Ids of texts from a tokenizers file whose pre-tokenizer drops white space, so that words can be encoded apart.

    The distinct words of a batch are encoded by the library once each, and its texts' ids are gathered from one flat
    array; nothing is remembered from batch to batch, so memory follows the batch alone. Where the library takes letters
    and punctuation apart and ignores case, as a trial of the file shows, words are first lower-cased (ASCII) and parted
    from the punctuation they end in, and words of plain lower-case letters skip the normaliser, which would leave them
    as they are. Other words go in one call, with a special token of the vocabulary between them, which the library takes
    out before anything else; words that could hold a special token go by themselves. `whole` falls back to whole texts
    for tokenizers that keep white space.
    """

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        self.model = load(path)
        special = [t.content for t in self.model.get_added_tokens_decoder().values() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.sep = min(special, default=None)
        self.marks = sorted({t.content[:1] for t in self.model.get_added_tokens_decoder().values()})
        probe = "It's  12\to'clock,\nisn't it? <|endoftext|>x ć d"
        self.whole = self._ids(probe) != [i for w in probe.replace("\n", " ").split(" ") if w for i in self._ids(w)]
        self.bare = type(self.model).from_str(self.model.to_str())
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        trial = ["The", "ÉTÉ", "été", "straße", "naïve", "don't", "o'clock", "x9", "a1b2", "qwertyuiop", "ÿ", "supercalifragilistic"]
        self.parted = self.sep is not None and all(self._ids(w + e) == self._ids(w.translate(_LOWER)) + self._ids(e) for w in trial for e in (".", ",", "!!", "...", '")', "%%%", "-", "@#", ";:"))
        self.parted &= all(self._ids(w) == self.bare.encode([w], is_pretokenized=True, add_special_tokens=False).ids for w in trial if w.isalpha() and w.islower())

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after the other, and how many each has."""
        if not self.sep:
            parts = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
            return np.array([i for p in parts for i in p], np.uint32), np.array([len(p) for p in parts], np.int64)
        joined = [self.sep.join(words[i : i + JOINED]) + self.sep for i in range(0, len(words), JOINED)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(ids == self.model.token_to_id(self.sep))
        if len(ends) != len(words):
            raise ValueError("a word holds the separator")
        return ids[ids != ids[ends[0]]], np.diff(ends, prepend=-1) - 1

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of plain letters."""
        ids, sizes = [], []
        for i in range(0, len(words), JOINED):
            e = self.bare.encode(words[i : i + JOINED], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(words[i : i + JOINED])))
        return np.concatenate(ids), np.concatenate(sizes)

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, first, size): where each of the distinct words has its ids in one array."""
        n = len(words)
        odd = np.zeros(n, bool)
        for mark in self.marks:
            odd |= pc.match_substring(words, mark).to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(words, f"^[{PLAIN}]+$").to_numpy(zero_copy_only=False) & ~odd if self.parted else np.zeros(n, bool)
        at, ids, sizes = [], [], []
        for kind, encode in ((plain, self._plain), (~plain & ~odd, self._encode), (odd, None)):
            where = np.flatnonzero(kind)
            some = words.take(pa.array(where)).to_pylist()
            done = 0
            for part in by_bytes(some) if encode else ([w] for w in some):
                if encode:
                    i, s = encode(part)
                else:
                    i = np.array(self._ids(part[0]), np.uint32)
                    s = np.array([len(i)], np.int64)
                at.append(where[done : done + len(part)])
                done += len(part)
                ids.append(i)
                sizes.append(s)
        first, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if at:
            at, sizes = np.concatenate(at), np.concatenate(sizes)
            first[at], size[at] = np.cumsum(sizes) - sizes, sizes
        return np.concatenate([np.zeros(0, np.uint32), *ids]), first, size

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array (null: empty)."""
        if self.whole:
            return [np.array(self._ids(t or ""), np.uint32) for t in texts.to_pylist()]
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        if self.parted and len(words):  # words become pairs of a stem and the punctuation it ends in
            odd = pc.match_substring(words, self.marks[0])
            for mark in self.marks[1:]:
                odd = pc.or_(odd, pc.match_substring(words, mark))
            low = pc.if_else(odd, words, pc.ascii_lower(words))
            stem = pc.if_else(odd, words, pc.replace_substring_regex(low, ENDED, "\\1"))
            end = pc.if_else(pc.equal(stem, low), "", pc.replace_substring_regex(low, ENDED, "\\2"))
            both = pa.concat_arrays([stem, end]).dictionary_encode()
            flat, first, size = self._table(both.dictionary)
            pair = both.indices.to_numpy().reshape(2, -1).T.ravel()
            flat, size = gather(flat, first[pair], size[pair]), size[pair].reshape(-1, 2).sum(axis=1)
            first = np.cumsum(size) - size
        else:
            flat, first, size = self._table(words)
        at = coded.indices.to_numpy()
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        return [gather(flat, first[at[a:b]], size[at[a:b]]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_ENCODERS: dict[str, IdEncoder] = {}


def encoder_of(path: str) -> IdEncoder:
    """A worker's encoder of a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = IdEncoder(path)
    return _ENCODERS[path]


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Deals items into k near-equal parts; gives the items' positions in each part (Karmarkar-Karp, k-way)."""
    if k == 1:
        return [list(range(len(sizes)))]
    # A partial partition: parts as (load over the lightest, items), heaviest first; only parts that hold something are kept.
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        a = a + [(0, [])] * (k - len(a))
        b = b + [(0, [])] * (k - len(b))
        merged = [(x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)]
        merged.sort(key=lambda t: -t[0])
        low = merged[-1][0]
        merged = [(x - low, p) for x, p in merged]
        while merged and not merged[-1][1] and not merged[-1][0]:
            merged.pop()
        heapq.heappush(heap, (-merged[0][0] if merged else 0, n, merged))
        n += 1
    parts = [p for _, p in heap[0][2]] if heap else []
    return parts + [[] for _ in range(k - len(parts))]


def powers(total: int) -> list[int]:
    """Powers of two that add up to a number, largest first."""
    return [1 << i for i in reversed(range(total.bit_length())) if total >> i & 1]


def pack_group(sizes: list[int], capacity: int, fill: bool = True) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """(windows, rest) of pieces (item, start, length), from items that are no longer than a window.

    The items are dealt uncut into as few windows as hold their sum, and into one more as long as the heaviest is over
    capacity. With `fill`, the lightest windows are then cut up to fill all others, and the rest is less than a window;
    without, no item is cut, windows are near-equal, and there is no rest.
    """
    total = sum(sizes)
    if not total:
        return [], []
    k = -(-total // capacity)
    while True:
        parts = difference(sizes, k)
        loads = [sum(sizes[i] for i in p) for p in parts]
        if max(loads) <= capacity:
            break
        k += 1
    order = sorted(range(k), key=lambda p: -loads[p])
    windows = [[(i, 0, sizes[i]) for i in parts[p] if sizes[i]] for p in order]
    if not fill:
        return [w for w in windows if w], []
    loose = [piece for w in reversed(windows[total // capacity :]) for piece in w]
    windows = windows[: total // capacity]
    for p, w in enumerate(windows):
        room = capacity - loads[order[p]]
        while room:
            i, start, length = loose.pop()
            take = min(room, length)
            w.append((i, start, take))
            if take < length:
                loose.append((i, start + take, length - take))
            room -= take
    return windows, loose


def _pack_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, base, done = encoder_of(path), TaskContext.get().partitionId() << 34, 0
    held: list[tuple[object, int, int, np.ndarray]] = []  # doc_id, start, ids in the document, remaining ids
    held_size = 0
    out: list[tuple] = []
    kind = pa.int64()

    def emit(window: list[tuple[object, int, int, np.ndarray]]) -> None:
        nonlocal done
        offset = 0
        for doc, start, of, ids in window:
            out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), of, base + done, offset))
            offset += len(ids)
        done += 1

    def flush(last: bool = False) -> None:
        windows, rest = pack_group([len(h[3]) for h in held], capacity)
        cut = lambda i, a, n: (held[i][0], held[i][1] + a, held[i][2], held[i][3][a : a + n])
        for window in windows:
            emit([cut(*piece) for piece in window])
        left = [cut(*piece) for piece in rest]
        held[:] = [] if last else left
        if last:  # windows whose lengths are powers of two are not padded
            for room in powers(sum(len(x[3]) for x in left)):
                window = []
                while room:
                    doc, at, of, ids = left.pop()
                    window.append((doc, at, of, ids[:room]))
                    if len(ids) > room:
                        left.append((doc, at + room, of, ids[room:]))
                    room -= len(window[-1][3])
                emit(window)

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        types = [kind, *[pa.int64()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    for batch in batches:
        docs = batch.column(0).to_pylist()
        kind = batch.column(0).type
        for doc, ids in zip(docs, encoder.ids(batch.column(1)), strict=True):
            ids = np.append(ids, np.uint32(end_id))
            of, at = len(ids), 0
            while of - at >= capacity:
                emit([(doc, at, of, ids[at : at + capacity])])
                at += capacity
            if at < of:
                held.append((doc, at, of, ids[at:]))
                held_size += of - at
                if held_size >= GROUP_WINDOWS * capacity:
                    flush()
                    held_size = sum(len(h[3]) for h in held)
        yield table_of(out)
        out.clear()
    flush(last=True)
    if out:
        yield table_of(out)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most `capacity` ids: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A document is its ids and `end_id`, so a null or empty text is one id; every id lies in one piece. All sequences
    are full but a task's last, which have lengths that are powers of two. Repeated rows are packed each; other columns
    aren't read; an empty table gives no piece.
    """
    bound_arrow(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_pack_batches, path=tokenizer, capacity=capacity, end_id=end_id), SCHEMA.format(kind))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2,048 tokens. A null or empty text is one id, the end mark;
    repeated rows and rows without an id are packed each; an empty table gives no piece."""
    return pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
