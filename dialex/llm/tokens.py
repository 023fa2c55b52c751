"""Token counts of whole texts, without ever building token lists for the caller.

Arrow functions get batches bounded in bytes, cut each text at safe boundaries (places no token can span), and
encode every distinct chunk once, in calls of about equal bytes. A text's count is the sum over its chunks. A stretch
without a safe boundary, however long, goes to the library whole and isn't remembered.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialex.llm.common import bound_arrow, table

#: Bytes of chunks in one call of the tokenizer.
CALL_BYTES = 1 << 20
#: Characters of chunks remembered by a worker before it starts anew, a few for each chunk's entry counted in, and the
#: longest chunk that is remembered at all.
KEEP_CHARS, ENTRY_CHARS, LONGEST = 64 << 20, 150, 256

_LOADED: dict[str, object] = {}


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; looked up on the machine that uses it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizer of a file, loaded once a worker: sentencepiece for .model, tokenizers for .json."""
    if path not in _LOADED:
        full = path if "/" in path else tokenizer_path(path)
        if full.endswith(".model"):
            import sentencepiece

            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=full)
        else:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            _LOADED[path] = Tokenizer.from_file(full)
    return _LOADED[path]


def by_bytes(chunks: Iterable[str], limit: int = CALL_BYTES) -> Iterator[list[str]]:
    """Lists of chunks of about `limit` UTF-8 bytes each; a longer chunk is a list of its own."""
    batch, size = [], 0
    for c in chunks:
        n = len(c) if c.isascii() else len(c.encode())
        if batch and size + n > limit:
            yield batch
            batch, size = [], 0
        batch.append(c)
        size += n
    if batch:
        yield batch


class Memo(dict):
    """Counts of chunks. `room` empties it when it is full; chunks that are too long are only kept until then."""

    def __init__(self) -> None:
        self.chars = 0

    def room(self, chunks: Iterable[str]) -> None:
        """Makes room for new chunks; what a batch needs stays until the next call."""
        if self.chars > KEEP_CHARS:
            self.clear()
            self.chars = 0
        self.chars += sum(min(len(c), LONGEST) + ENTRY_CHARS for c in chunks)

    def forget_long(self, chunks: Iterable[str]) -> None:
        for c in chunks:
            if len(c) > LONGEST:
                del self[c]


class PieceCounter:
    """Counts for a sentencepiece model of the usual kind: spaces become a mark that starts a word, and no piece holds
    the mark after another character, so a text may be cut before each run of spaces."""

    _runs = re.compile(" *[^ ]+| +")

    def __init__(self, path: str):
        self.model = load(path)
        ids = range(self.model.get_piece_size())
        mark = "▁"
        if any(mark in self.model.id_to_piece(i).lstrip(mark) for i in ids) or self.model.encode("x", out_type=str)[0][0] != mark:
            raise ValueError(f"{path}: pieces may span words; texts can't be cut before spaces")
        self.known = Memo()

    def learn(self, chunks: set[str]) -> None:
        self.known.room(chunks - self.known.keys())
        for batch in by_bytes(chunks - self.known.keys()):
            for c, ids in zip(batch, self.model.encode(batch, num_threads=1), strict=True):
                self.known[c] = len(ids)

    def split(self, text: str) -> tuple[list[str], int]:
        """The chunks, and the count of what isn't a chunk (spaces at the end)."""
        text = text.replace("▁", " ")
        if "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" "), 0
        found = self._runs.findall(" " + text)
        tail = 0
        if found[-1][-1] == " ":  # a last run has no word after it
            last = found.pop()
            tail = len(self.model.encode("x" + last)) - len(self.model.encode("x")) if found else len(self.model.encode(text))
        return [c[1:] for c in found], tail

    def counts(self, texts: list[str]) -> list[int]:
        parts = [self.split(t) if t else ([], 0) for t in texts]
        chunks = {c for words, _ in parts for c in words}
        self.learn(chunks)
        get = self.known.__getitem__
        out = [sum(map(get, words)) + tail for words, tail in parts]
        self.known.forget_long(chunks)
        return out


class JsonCounter:
    """Counts for a tokenizers file. Whether it may be cut at single spaces is tried on a few strings once; if not,
    whole texts are encoded."""

    _cut = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, path: str):
        self.model = load(path)
        self.known = Memo()
        probe = ["a b", "It's 12 o'clock, isn't it? Yes, 99.5% été", "x <|endoftext|> y", "A.B ć d ... e"]
        self.safe = all(self._ids(t) == [i for c in self._cut.split(t) for i in self._ids(c)] for t in probe)

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def counts(self, texts: list[str]) -> list[int]:
        parts = [(self._cut.split(t) if self.safe else [t]) if t else [] for t in texts]
        chunks = {c for p in parts for c in p}
        self.known.room(chunks - self.known.keys())
        for batch in by_bytes(chunks - self.known.keys()):
            for c, e in zip(batch, self.model.encode_batch(batch, add_special_tokens=False), strict=True):
                self.known[c] = len(e.ids)
        get = self.known.__getitem__
        out = [sum(map(get, p)) for p in parts]
        self.known.forget_long(chunks)
        return out


_COUNTERS: dict[str, PieceCounter | JsonCounter] = {}


def counter(path: str) -> PieceCounter | JsonCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = (PieceCounter if path.endswith(".model") else JsonCounter)(path)
    return _COUNTERS[path]


def _count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = counter(path).counts
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(count(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of `docs`.

    `tokenizer` is a path, or the bare name of a public vocabulary file. No begin, end or added special tokens, no
    truncation. A null or empty text has no bytes and no tokens; repeated rows are counted each; other columns, whatever
    their names, aren't read; an empty table gives an empty result. Nothing is shuffled.
    """
    bound_arrow(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_count_batches, path=tokenizer), f"doc_id {kind}, n_bytes long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentencepiece counts of all documents, with the rows over 4,096 tokens marked. Null and empty texts have no
    tokens; repeated rows and rows without an id are counted each; an empty table gives no row."""
    counted = count_tokens(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
