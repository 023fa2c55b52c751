"""Alignment of two tokenizers' tokens, by a dictionary of groups.

A text's bytes are cut wherever tokens of both kinds end; a group is what lies between two cuts, and the tokens of a group
are linked with each other. Most groups occur again and again, so they are interned: a group's key is its ids, links are
expanded once for each distinct group and multiplied by the documents that hold it, and what comes out for a group is
joined back to the documents by the key. Where a document holds an id pair in several distinct groups, the counts take it
once: the surplus is counted while the document is at hand.

Both tokenizers start anew at a single space between two other characters, so texts are cut there, and each distinct chunk
is encoded once a worker, as long as it is remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialex.llm.common import bound_arrow, materialise, table
from dialex.llm.tokens import load, tokenizer_path

#: Characters of documents worked on at a time, and of unknown chunks encoded in one call.
SLICE_CHARS, CALL_CHARS = 1 << 21, 1 << 17
#: Chunks and groups a worker remembers before it sends what it has counted and starts anew.
KEEP = 500_000
#: Longer keys are replaced by their hash.
LONGEST_KEY = 96
#: Groups sent to all tasks for the way back, those in most documents, at most; rarer ones are joined by a shuffle.
HOT_GROUPS = 1 << 16

_CUT = re.compile(r"(?<=\S) (?=\S)")

SCHEMA = (
    "kind int, row long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<string>, times array<int>, "
    "key string, a array<int>, a_n array<int>, b array<int>, b_n array<int>, docs long, pair long"
)
_DOC, _GROUP, _SURPLUS = 0, 1, 2


def _byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the
    others, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _pieces(chunks: Iterable[str], limit: int) -> Iterator[list[str]]:
    batch, size = [], 0
    for c in chunks:
        if batch and size + len(c) > limit:
            yield batch
            batch, size = [], 0
        batch.append(c)
        size += len(c) + 1
    if batch:
        yield batch


#: White space besides the space.
_BLANKS = [chr(i) for i in range(1, 0x3001) if chr(i).isspace() and chr(i) != " "]


def words(text: str) -> list[str]:
    """The chunks of a text. Where no space stands beside white space, as in most texts, it is split by spaces."""
    if "  " in text or text[:1].isspace() or text[-1:].isspace() or any(b + " " in text or " " + b in text for b in _BLANKS if b in text):
        return _CUT.split(text)
    return text.split(" ")


def segments(text: str, limit: int = SLICE_CHARS) -> Iterator[str]:
    """A text in parts of about `limit` characters, cut at safe spaces, which are left out."""
    at = 0
    while len(text) - at > limit and (m := _CUT.search(text, at + limit - 1)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


class Aligner:
    """Chunks and groups met so far, by number, with their figures in arrays."""

    def __init__(self, a_path: str, b_path: str):
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path if "/" in a_path else tokenizer_path(a_path)), load(b_path)
        self.a.encode_special_tokens = True  # their strings in a text are then ordinary text
        char = _byte_chars()
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(char[c] for c in t) if t and all(c in char for c in t) else (t or "").encode() for t in names]
        model, ids = self.b, range(self.b.get_piece_size())
        self.b_bytes = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        if any("▁" in model.id_to_piece(i).lstrip("▁") for i in ids) or model.encode("x", out_type=str)[0][0] != "▁":
            raise ValueError(f"{b_path}: pieces may span words; texts can't be cut before spaces")
        if self.a.encode(" a b c", add_special_tokens=False).ids != [i for c in (" a", " b", " c") for i in self.a.encode(c, add_special_tokens=False).ids]:
            raise ValueError(f"{a_path}: texts can't be cut before spaces")
        self.a_len, self.b_len = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.a_str, self.b_str = ([str(i) for i in range(len(v))] for v in (self.a_bytes, self.b_bytes))
        self.n_b_ids = len(self.b_bytes)
        self.clear()

    def clear(self) -> None:
        self.chunk: dict[str, int] = {}
        self.group: dict[str, int] = {}
        self.group_a: list[tuple[int, ...]] = []
        self.group_b: list[tuple[int, ...]] = []
        self.single: dict[int, int] = {}
        self.pairs: dict[int, np.ndarray] = {}
        self.sizes = self.flat = self.a_n = self.b_n = self.docs = np.zeros(0, np.int64)
        self.ok = np.zeros(0, bool)
        self.keys, self.names = pa.array([], pa.string()), np.zeros(0, object)
        self.surplus: dict[int, int] = {}

    def full(self) -> bool:
        return max(len(self.chunk), len(self.group), len(self.surplus) // 4) > KEEP

    def _encode(self, joined: str) -> tuple[list[int], list[int], bool]:
        """Ids of both kinds, and whether their bytes are the space and the text."""
        a = self.a.encode_batch_fast([" " + joined], add_special_tokens=False)[0].ids
        b = self.b.encode(joined, num_threads=1) if joined else []
        want = (" " + joined).encode()
        same = b"".join([self.a_bytes[i] for i in a]) == want and b"".join([self.b_bytes[i] for i in b]) == want
        return a, b, same

    def _intern(self, a: tuple[int, ...], b: tuple[int, ...]) -> int:
        key = ",".join([self.a_str[i] for i in a]) + "|" + ",".join([self.b_str[i] for i in b])
        n = self.group.get(key)
        if n is None:
            n = self.group[key] = len(self.group)
            self.group_a.append(a)
            self.group_b.append(b)
        return n

    def _learn_block(self, chunks: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, bool]]:
        """(chunks, groups of each, groups, whether they have tokens) of chunks that may be joined by spaces and encoded
        at once."""
        a, b, same = self._encode(" ".join(chunks))
        if not same:
            if len(chunks) > 1:
                for c in chunks:
                    yield from self._learn_block([c])
            else:
                yield chunks, np.zeros(1, np.int64), np.zeros(0, np.int64), False
            return
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.a_len[ids_a]), np.cumsum(self.b_len[ids_b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        to_a, to_b = np.searchsorted(ends_a, cuts) + 1, np.searchsorted(ends_b, cuts) + 1
        at_a, at_b = np.append(0, to_a[:-1]), np.append(0, to_b[:-1])
        ends = np.cumsum([len(c) + 1 if c.isascii() else len(c.encode()) + 1 for c in chunks])
        last = np.searchsorted(cuts, ends)
        if not np.array_equal(cuts[last], ends):
            raise ValueError("tokens span the places where texts are cut")
        groups = np.empty(len(cuts), np.int64)
        alone = (to_a - at_a == 1) & (to_b - at_b == 1)
        codes, back = np.unique(ids_a[at_a[alone]] * self.n_b_ids + ids_b[at_b[alone]], return_inverse=True)
        numbers = np.empty(len(codes), np.int64)
        for i, code in enumerate(codes.tolist()):
            n = self.single.get(code)
            if n is None:
                x, y = divmod(code, self.n_b_ids)
                n = self.single[code] = self._intern((x,), (y,))
            numbers[i] = n
        groups[alone] = numbers[back]
        for g in np.flatnonzero(~alone).tolist():
            groups[g] = self._intern(tuple(a[at_a[g] : to_a[g]]), tuple(b[at_b[g] : to_b[g]]))
        yield chunks, np.diff(last + 1, prepend=0), groups, True

    def learn(self, chunks: list[str]) -> None:
        """Takes in new chunks; those with white space at an end, or nothing in them, are encoded apart."""
        if not chunks:
            return
        apart = [c for c in chunks if not c or c[0].isspace() or c[-1].isspace()]
        if apart:
            odd = set(apart)
            chunks = [c for c in chunks if c not in odd]
        sizes, flat, ok = [self.sizes], [self.flat], [self.ok]
        for block in (*_pieces(chunks, CALL_CHARS), *([c] for c in apart)):
            for names, n, groups, fine in self._learn_block(block):
                self.chunk.update(zip(names, range(len(self.chunk), len(self.chunk) + len(names)), strict=True))
                sizes.append(n)
                flat.append(groups)
                ok.append(np.full(len(names), fine))
        self.sizes, self.flat, self.ok = np.concatenate(sizes), np.concatenate(flat), np.concatenate(ok)
        known = len(self.a_n)
        self.a_n, self.b_n = (np.append(old, np.array([len(x) for x in ids[known:]], np.int64)) for old, ids in ((self.a_n, self.group_a), (self.b_n, self.group_b)))
        names = list(islice(self.group, known, None))
        self.names = np.append(self.names, np.array([*names, None], object)[:-1])
        self.keys = pa.concat_arrays([self.keys, pa.array([short(k) for k in names], pa.string())])

    def _numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.chunk.__getitem__, words), np.int64, len(words))

    def chunk_ids(self, texts: list[str]) -> list[np.ndarray]:
        """The chunks of each text by number. Texts longer than a slice are gone through in parts."""
        split = [words(t) if len(t) <= SLICE_CHARS else None for t in texts]
        self.learn([*{c for w in split if w for c in w} - self.chunk.keys()])
        out = []
        for t, w in zip(texts, split, strict=True):
            if w is not None:
                out.append(self._numbers(w))
                continue
            parts = []
            for part in segments(t):
                own = words(part)
                self.learn([*set(own) - self.chunk.keys()])
                parts.append(self._numbers(own))
            out.append(np.concatenate(parts))
        return out

    def work(self, texts: list[str | None]) -> tuple[list, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text (n_a, n_b, n_groups, n_links, sha); and its distinct groups, as (text's place, group, times)."""
        given = [i for i, t in enumerate(texts) if t]
        found = zip(given, self.chunk_ids([texts[i] for i in given]), strict=True)
        chunks = {i: c for i, c in found if self.ok[c].all()}
        sizes, a_n, b_n = self.sizes, self.a_n, self.b_n
        starts = np.cumsum(sizes) - sizes
        each = np.concatenate([np.zeros(0, np.int64), *chunks.values()])
        n = sizes[each]
        groups = self.flat[np.repeat(starts[each] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        lengths = np.zeros(len(texts), np.int64)
        lengths[list(chunks)] = [int(sizes[c].sum()) for c in chunks.values()]
        ends = np.cumsum(lengths)
        shas = [hashlib.sha256(";".join(self.names[groups[end - n : end]].tolist()).encode()).hexdigest() if n else "" for n, end in zip(lengths.tolist(), ends.tolist(), strict=True)]
        many = max(len(self.group), 1)
        code, times = np.unique(np.repeat(np.arange(len(texts)), lengths) * many + groups, return_counts=True)
        place, groups = np.divmod(code, many)
        cells = [np.bincount(place, w, len(texts)).astype(np.int64).tolist() for w in (times * a_n[groups], times * b_n[groups], times, times * a_n[groups] * b_n[groups])]
        self.count(place, groups, a_n, b_n)
        return list(zip(*cells, shas, strict=True)), (place, groups, times)

    def _pairs(self, g: int) -> np.ndarray:
        """The distinct id pairs of a group, as numbers."""
        if g not in self.pairs:
            a, b = np.unique(self.group_a[g]), np.unique(self.group_b[g])
            self.pairs[g] = (a[:, None] * self.n_b_ids + b).ravel()
        return self.pairs[g]

    def count(self, place: np.ndarray, groups: np.ndarray, a_n: np.ndarray, b_n: np.ndarray) -> None:
        """Adds the documents of each group, and how often pairs are in further groups of a document that has them."""
        here = np.bincount(groups, minlength=len(self.group))
        self.docs = here + np.pad(self.docs, (0, len(here) - len(self.docs)))
        several = a_n[groups] * b_n[groups] > 1
        order = np.unique(groups[several])
        if not len(order):
            return
        pairs = [self._pairs(g) for g in order.tolist()]
        sizes, flat = np.array([len(x) for x in pairs]), np.concatenate(pairs)
        starts = np.cumsum(sizes) - sizes
        span = len(self.a_bytes) * self.n_b_ids
        uniq = np.unique(groups[~several])
        first = np.array([self.group_a[g][0] * self.n_b_ids + self.group_b[g][0] for g in uniq.tolist()], np.int64)
        own, single = place[several], place[~several] * span + first[np.searchsorted(uniq, groups[~several])]
        which = np.searchsorted(order, groups[several])
        for at, till in _ranges(own, sizes[which]):
            n = sizes[which[at:till]]
            got = np.repeat(own[at:till], n) * span + flat[np.repeat(starts[which[at:till]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            low, high = np.searchsorted(place[~several], [own[at], own[till - 1] + 1])
            pair, seen = np.unique(np.concatenate([got, np.intersect1d(single[low:high], got)]), return_counts=True)
            more = seen > 1
            over, inverse = np.unique(pair[more] % span, return_inverse=True)
            for p, k in zip(over.tolist(), np.bincount(inverse, seen[more] - 1).astype(np.int64).tolist(), strict=True):
                self.surplus[p] = self.surplus.get(p, 0) + k

    def counted(self) -> list[dict]:
        """What was counted since the last time, as rows."""
        rows = []
        names = list(self.group)
        for g in np.flatnonzero(self.docs).tolist():
            (a, a_n), (b, b_n) = (np.unique(x[g], return_counts=True) for x in (self.group_a, self.group_b))
            rows.append({"kind": _GROUP, "key": short(names[g]), "a": a.tolist(), "a_n": a_n.tolist(), "b": b.tolist(), "b_n": b_n.tolist(), "docs": int(self.docs[g])})
        rows += [{"kind": _SURPLUS, "pair": p, "docs": -n} for p, n in self.surplus.items()]
        self.forget_counts()
        return rows

    def forget_counts(self) -> None:
        """Begins counting anew; chunks and groups stay known."""
        self.docs, self.surplus = np.zeros(len(self.group), np.int64), {}


def _ranges(place: np.ndarray, sizes: np.ndarray, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Stretches of whole documents with about `limit` pairs each."""
    at, total = 0, np.cumsum(sizes)
    while at < len(place):
        till = int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right"))
        till = int(np.searchsorted(place, place[min(max(till, at + 1), len(place)) - 1], side="right"))
        yield at, till
        at = till


def short(key: str) -> str:
    return key if len(key) <= LONGEST_KEY else "#" + hashlib.sha256(key.encode()).hexdigest()


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _filled(schema: pa.Schema, given: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)


def _align_batches(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    tool = aligner(a_path, b_path)
    tool.forget_counts()  # those left by a task that failed belong to nobody
    for batch in batches:
        texts = batch.column(2).to_pylist()
        at = 0
        while at < len(texts):
            till, size = at, 0
            while till < len(texts) and (till == at or size + len(texts[till] or "") <= SLICE_CHARS):
                size += len(texts[till] or "")
                till += 1
            rows, (place, groups, times) = tool.work(texts[at:till])
            ends = pa.array(np.searchsorted(place, np.arange(till - at + 1)).astype(np.int32))
            n_a, n_b, n_groups, n_links, sha = zip(*rows, strict=True)
            yield _filled(
                schema,
                {
                    "kind": pa.array(np.full(till - at, _DOC, np.int32)), "row": batch.column(0).slice(at, till - at), "doc_id": batch.column(1).slice(at, till - at),
                    "n_a": pa.array(n_a, pa.int64()), "n_b": pa.array(n_b, pa.int64()), "n_groups": pa.array(n_groups, pa.int64()), "n_links": pa.array(n_links, pa.int64()), "groups_sha256": pa.array(sha, pa.string()),
                    "keys": pa.ListArray.from_arrays(ends, tool.keys.take(pa.array(groups))), "times": pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
                },
                till - at,
            )
            if tool.full():
                yield from _rows(tool.counted(), schema)
                tool.clear()
            at = till
    yield from _rows(tool.counted(), schema)


def _rows(rows: list[dict], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), size):
        yield pa.RecordBatch.from_pylist(rows[at : at + size], schema=schema)


def _hot_floor(scores: DataFrame, most: int) -> int:
    """The number of documents from which a group is hot, so that at most `most` groups are: counted by powers of the
    square root of two, a few dozen rows."""
    step = F.floor(F.log2("docs") * 2).cast("int")
    floor, left = None, most
    for row in sorted(scores.groupBy(step.alias("step")).count().collect(), reverse=True):
        left -= row["count"]
        if left < 0:
            break
        floor = row["step"]
    return 1 << 62 if floor is None else int(np.ceil(2 ** (floor / 2) - 1e-9))


def align(docs: DataFrame, a_tokenizer: str, b_tokenizer: str, id_col: str = "doc_id", text_col: str = "text", hot_groups: int = HOT_GROUPS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Aligns the tokens of a byte-level vocabulary (A, of space and text) with those of a piece vocabulary (B, of the text).

    Returns per row of `docs` (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256); the groups (key,
    a, a_n, b, b_n, docs, count_sum, n_best), ids in order and how often each; and the id pairs (a, b, count, best).
    A pair's count is the number of rows that hold it linked, and n_best the links whose count is their A id's highest.

    Null and empty texts, and those that either tokenizer doesn't give back byte by byte, have no tokens: zeros and ''.
    Repeated rows and rows without an id are documents each. An empty table gives empty results. Other columns, whatever
    their names, aren't read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    bound_arrow(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = SCHEMA.format(id=docs.schema[id_col].dataType.simpleString())
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    done = materialise(rows.mapInArrow(partial(_align_batches, a_path=a_tokenizer, b_path=b_tokenizer, schema=arrow), schema), "aligned")

    groups = done.where(F.col("kind") == _GROUP).groupBy("key").agg(*[F.first(c).alias(c) for c in ("a", "a_n", "b", "b_n")], F.sum("docs").alias("docs"))
    groups = materialise(groups, "groups")
    by_a = groups.select("key", "docs", F.explode(F.arrays_zip("a", "a_n")).alias("x"), F.arrays_zip("b", "b_n").alias("ys"))
    links = by_a.select("key", "docs", "x", F.explode("ys").alias("y"))
    links = links.select("key", "docs", F.col("x.a").alias("a"), F.col("y.b").alias("b"), (F.col("x.a_n").cast("long") * F.col("y.b_n")).alias("n"))
    b_ids = _piece_count(b_tokenizer)
    surplus = done.where(F.col("kind") == _SURPLUS).select(F.expr(f"CAST(pair DIV {b_ids} AS INT)").alias("a"), F.expr(f"CAST(pair % {b_ids} AS INT)").alias("b"), "docs")
    counts = links.select("a", "b", "docs").unionAll(surplus).groupBy("a", "b").agg(F.sum("docs").alias("count"))
    counts = materialise(counts, "pair-counts")
    top = counts.groupBy("a").agg(F.max("count").alias("top"))  # a row for each id of A
    pairs = materialise(counts.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best")), "pairs")
    scored = links.join(pairs, ["a", "b"]).groupBy("key").agg(F.sum(F.col("n") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"))
    scores = materialise(groups.join(scored, "key"), "scores")

    floor = _hot_floor(scores, hot_groups)
    hot = scores.where(F.col("docs") >= floor).select("key", "count_sum", "n_best")
    held = done.where(F.col("kind") == _DOC).select("row", F.explode(F.arrays_zip("keys", "times")).alias("g")).select("row", F.col("g.keys").alias("key"), F.col("g.times").alias("times"))
    sums = [F.sum(F.col("times") * F.col(c)).alias(c) for c in ("n_best", "count_sum")]
    common = held.join(F.broadcast(hot), "key").groupBy("row").agg(*sums)
    rare = held.join(F.broadcast(hot.select("key")), "key", "left_anti").join(scores.select("key", "count_sum", "n_best"), "key").groupBy("row").agg(*sums)
    total = common.unionAll(rare).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_best", "count_sum")])
    own = done.where(F.col("kind") == _DOC).select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("long")
    out = own.join(total, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, zero).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
    return out, scores, pairs


def _piece_count(path: str) -> int:
    return load(path).get_piece_size()


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of the byte-level and the piece vocabulary in all documents. What nulls, repeated rows,
    empty tables and the like give is said at `align`."""
    return align(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", "piece_bpe_32k.model")[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_token_alignment": op11_token_alignment}
ORACLES: dict[str, str] = {}
