"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_odds_z(y: Column, n: Column, y_all: Column, n_all: Column, alpha: float = 100.0) -> Column:
    """The z-score of a word's log-odds ratio against the whole corpus, with a Dirichlet prior in proportion to the
    corpus counts. Null where the prior or a denominator isn't positive."""
    prior = F.lit(alpha) * y_all / F.nullif(n_all, F.lit(0))
    rest, rest_all = n + alpha - y - prior, n_all + alpha - y_all - prior
    delta = F.log((y + prior) / rest) - F.log((y_all + prior) / rest_all)
    return F.when((prior > 0) & (rest > 0) & (rest_all > 0), delta / F.sqrt(1 / (y + prior) + 1 / (y_all + prior)))


def per_million(count: Column, total: Column) -> Column:
    return count / F.nullif(total, F.lit(0)) * 1e6


def distinctiveness(rate_per_million: Column, zipf: Column) -> Column:
    """How much commoner a word is here than in general use, as a binary logarithm; unknown words count as zipf 1."""
    return F.round(F.log2(rate_per_million / F.pow(F.lit(10.0), F.greatest(zipf, F.lit(1.0)) - 3)), 2)


def shift_score(late: Column, early: Column) -> Column:
    return F.round(F.log2((late + 0.1) / (early + 0.1)), 2)


def pair_cosines(vectors: DataFrame, pairs: DataFrame, key: str = "film_id", word: str = "word", count: str = "count") -> DataFrame:
    """pairs(a, b) with cosine: of the count vectors of both; 0 where they share no word. Only vectors in a pair are
    moved; pairs are read several times, so they are best written before."""
    v = vectors.select(key, word, F.col(count).cast("double").alias("c"))
    norms = v.groupBy(key).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    left = pairs.join(v.withColumnsRenamed({key: "a", "c": "ca"}), "a")
    right = v.withColumnsRenamed({key: "b", "c": "cb"}).join(pairs.select("b").distinct(), "b", "left_semi")
    dots = left.join(right, ["b", word]).groupBy("a", "b").agg(F.sum(F.col("ca") * F.col("cb")).alias("dot"))
    out = pairs.join(dots, ["a", "b"], "left").join(norms.withColumnsRenamed({key: "a", "norm": "na"}), "a", "left").join(norms.withColumnsRenamed({key: "b", "norm": "nb"}), "b", "left")
    value = F.coalesce(F.col("dot"), F.lit(0.0)) / F.nullif(F.col("na") * F.col("nb"), F.lit(0.0))
    return out.select(*pairs.columns, F.coalesce(value, F.lit(0.0)).alias("cosine"))


def logistic_score(rates: Column, model: dict) -> Column:
    """1 / (1 + exp(-z)) for an array of rates and a model of mean, std, coef arrays and an intercept."""
    coef = F.array(*[F.lit(c / s) for c, s in zip(model["coef"], model["std"], strict=True)])
    base = model["intercept"] - sum(c * m / s for c, m, s in zip(model["coef"], model["mean"], model["std"], strict=True))
    z = F.aggregate(F.zip_with(rates, coef, lambda x, c: x * c), F.lit(float(base)), lambda a, x: a + x)
    return 1 / (1 + F.exp(-z))


def _figure(value: Column, digits: int) -> Column:
    return F.format_number(F.round(value, digits), digits)


def per_1k_label(count: Column, total: Column) -> Column:
    """A rate per thousand words to read: one decimal if it has one, and never 0 for what was said."""
    rate = count / F.greatest(total, F.lit(1)) * 1000
    return F.when(rate == 0, "0").when(rate < 0.1, "<0.1").otherwise(F.regexp_replace(_figure(rate, 1), r"\.0$", ""))


def per_film_label(value: Column) -> Column:
    """An average per film to read: one decimal from 1 up, two below."""
    return F.when(value == 0, "0").when(value < 0.01, "<0.01").when(value >= 1, _figure(value, 1)).otherwise(_figure(value, 2))


def shift_ratio(score: Column) -> Column:
    """How many times as often, from a shift in powers of two."""
    return F.pow(F.lit(2.0), F.abs(score))
