"""A quality classifier: a generalised additive model with pairwise interactions.

Texts are described by a few dozen figures. Cyclic boosting of shallow trees learns one lookup table a figure (over
quantile bins), then one a pair of figures where what is left over depends on both; a score is the sum of the bins'
entries. Scoring adds up table entries for whole batches at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from dialex.llm.common import bound_arrow, table

#: Labelled rows that a model is fitted on at most, those with the smallest hashes of their ids.
TRAIN_ROWS = 12_000
BINS = 48
PAIR_BINS = 8
FEATURES = (
    "log_bytes", "log_words", "word_length", "long_word", "upper", "digit", "punct", "symbol", "bang", "pipe", "angle", "non_ascii", "space",
    "distinct_words", "top_word", "repeat_word", "distinct_bigrams", "distinct_lines", "line_words", "stops", "upper_words", "odd_words", "short_words", "worst_line",
)
_CLASS = np.zeros(256, np.uint8)
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b".,;:'\"-()?", 4), (b"*$%&#@+=~^_\\/[]{}`", 5), (b"!", 6), (b"|", 7), (b"<>", 8), (b" \t\n\r\x0b\x0c", 9)):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 10
_ODD = re.compile(r"[^\w\s.,;:'\"()?-]")


def describe(text: str) -> list[float]:
    """The figures of a text; those of an empty one are all zero."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    n = len(raw)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=11).tolist()
    words = text.split()
    count = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1, kinds[1] + kinds[2] + kinds[10])
    base = [np.log1p(n), np.log1p(count), n / max(1, count), 0.0, kinds[1] / letters, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n, kinds[8] / n, kinds[10] / n, kinds[9] / n]
    if not count:
        return [float(x) for x in base] + [0.0] * (len(FEATURES) - len(base))
    tally = Counter(words)
    top = tally.most_common(1)[0][1] / count
    repeats = sum(map(str.__eq__, words, words[1:])) / count
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, count - 1)
    upper = odd = short = 0
    longest = 0
    for w, k in tally.items():
        size = len(w)
        longest = max(longest, size)
        upper += k * (size > 1 and w.isupper())
        odd += k * (not w.isalpha() and _ODD.search(w) is not None)
        short += k * (size <= 3)
    stops = kinds[4] / count
    worst = 0.0
    for x in lines:
        if len(x) > 20:
            odd_here = sum(map(x.count, "|!*$%&#"))
            worst = max(worst, odd_here / len(x))
    base[3] = np.log1p(longest)
    rest = [len(tally) / count, top, repeats, pairs, len(set(lines)) / max(1, len(lines)), count / max(1, len(lines)), stops, upper / count, odd / count, short / count, worst]
    return [float(x) for x in base + rest]


@dataclass
class Model:
    """edges[f]: upper bounds of the bins; tables[f]: their scores; pairs: (f, g, coarse bins of both, table)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def logits(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, f]) for f, e in enumerate(self.edges)]
        total = np.full(len(x), self.base)
        for b, t in zip(bins, self.tables, strict=True):
            total += t[b]
        for f, g, cf, cg, t in self.pairs:
            total += t[cf[bins[f]], cg[bins[g]]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Steps for the bins of one figure: a tree of a few leaves grown on the bins' sums of gradients, best split first."""
    g, h = np.concatenate([[0.0], np.cumsum(grad)]), np.concatenate([[0.0], np.cumsum(hess)])
    gain_of = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    cuts = [0, len(grad)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = gain_of(a, m) + gain_of(m, b) - gain_of(a, b)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(m[k])), key=lambda t: t[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    step = np.zeros(len(grad))
    for a, b in zip(cuts, cuts[1:], strict=False):
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return step


def _pair_tree(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Steps for a grid of bins: one split of the first figure, and one of the second on either side of it."""
    best, found = 0.0, np.zeros_like(grad)
    whole = grad.sum() ** 2 / (hess.sum() + ridge)
    for cut in range(1, len(grad)):
        step, gain = np.zeros_like(grad), -whole
        for part in (slice(0, cut), slice(cut, None)):
            g, h = grad[part].sum(axis=0), hess[part].sum(axis=0)
            one = _tree(g, h, 2, ridge)
            step[part] = one
            gain += float((one * g).sum())
        if gain > best:
            best, found = gain, step
    return found, best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pairs: int = 6, rate: float = 0.15, leaves: int = 4, ridge: float = 2.0) -> Model:
    """Fits tables by cyclic boosting of the logistic loss. With no rows or one class, scores are a smoothed share of
    ones."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    model = Model(base, edges, [np.zeros(len(e) + 1) for e in edges], [])
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)]
    z = np.full(len(y), base)

    def sums(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

    for _ in range(rounds):
        for f, t in enumerate(model.tables):
            if len(t) > 1:
                step = rate * _tree(*sums(bins[f], len(t)), leaves, ridge)
                t += step
                z += step[bins[f]]
    coarse = [(np.arange(len(t)) * PAIR_BINS // max(1, len(t))).astype(np.int64) for t in model.tables]
    grids, gains = {}, []
    for f in range(len(bins)):
        for g in range(f):
            grids[f, g] = at = coarse[f][bins[f]] * PAIR_BINS + coarse[g][bins[g]]
            grad, hess = (s.reshape(PAIR_BINS, PAIR_BINS) for s in sums(at, PAIR_BINS**2))
            gains.append((_pair_tree(grad, hess, ridge)[1], f, g))
    chosen = [(f, g) for gain, f, g in sorted(gains, reverse=True)[:pairs] if gain > 0]
    tables = {fg: np.zeros((PAIR_BINS, PAIR_BINS)) for fg in chosen}
    for _ in range(rounds // 3):
        for fg in chosen:
            grad, hess = (s.reshape(PAIR_BINS, PAIR_BINS) for s in sums(grids[fg], PAIR_BINS**2))
            step = rate * _pair_tree(grad, hess, ridge)[0]
            tables[fg] += step
            z += step.ravel()[grids[fg]]
    model.pairs = [(f, g, coarse[f], coarse[g], t) for (f, g), t in tables.items()]
    return model


def _describe_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [describe(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])


def _score_batches(batches: Iterator[pa.RecordBatch], model: Model, out: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([describe(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(batch.num_rows, -1)
        scores = model.scores(x) if len(x) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], out])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from labels(doc_id, label) of documents (doc_id, text).

    At most `train_rows` labels are used, those with the smallest hashes of their ids; their number bounds what is
    broadcast and what reaches the driver. Labels that are null, or whose document is missing, count for nothing; of
    several labels of a document the largest holds.
    """
    bound_arrow(docs.sparkSession)
    chosen = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("label").cast("double").alias("y"), "text")
    found = texts.mapInArrow(_describe_batches, "y double, x array<double>").toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(found.num_rows, len(FEATURES))
    y = found.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # rows come in any order; sums shouldn't depend on it
    return fit(x[order], y[order])


def held_out(doc_id: Column) -> Column:
    """True for the third of ids that no model may learn from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: Model, *keep: Column, out: str = "score") -> DataFrame:
    """The columns `keep` of docs, and `out`: the model's 0 to 1 for the whole of column text (null: empty). Repeated rows
    are scored each; an empty table gives an empty result; `out` must not be the name of a column in `keep`."""
    bound_arrow(docs.sparkSession)
    kept = docs.select(*keep).schema.fields  # under plain names, as Arrow functions don't take names with dots
    rows = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").alias("text"))
    schema = StructType([*[StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)], StructField("score", DoubleType())])
    scored = rows.mapInArrow(partial(_score_batches, model=model, out="score"), schema)
    return scored.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)], F.col("score").alias(out))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    return train(docs, labels)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels outside the held-out third. Null and empty texts are scored as
    texts whose figures are all zero; repeated rows are scored each; without labels every score is one half."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, quality_model(spark, docs, sf_dir), F.col("doc_id"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_quality": op10_quality}
ORACLES: dict[str, str] = {}
