"""Checks of corpus quality: tiers, words out of their time, odd rates, twins under two names, casts of other films."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialex.functions.lexicon import FIRST_YEARS, STRONG_PROFANITY
from dialex.functions.predicates import implausible_rate
from dialex.functions.stats import pair_cosines
from dialex.sources.scratch import written

SILENT_BEFORE, SILENT_RATE, PROFANITY_BEFORE = 1928, 45, 1968


def era(year: Column) -> Column:
    return F.when(year < 1930, "pre-1930").when(year < 1968, "1930-67").when(year < 2000, "1968-99").otherwise("2000+")


def tier_tally(films: DataFrame) -> DataFrame:
    """Films by tier, flags, whether English is the original language, and era."""
    return films.groupBy(F.col("quality").alias("tier"), F.array_join("quality_flags", ",").alias("flags"), (F.col("lang") == "en").alias("english"), era(F.col("year")).alias("era")).agg(F.count("*").alias("n"))


def said_list() -> Column:
    """The words of a group with their counts, most said first."""
    entry = F.struct((-F.col("count")).alias("o"), F.col("word").alias("w"), F.concat(F.col("word"), F.lit(" x"), F.col("count").cast("string")).alias("s"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["s"]), ", ")


def anachronisms(films: DataFrame, words: DataFrame, first_years: dict[str, int] | None = None) -> DataFrame:
    """(film_id, title, year, words): ok films with words from before they existed."""
    firsts = first_years or FIRST_YEARS
    known = F.create_map(*[F.lit(x) for kv in firsts.items() for x in kv])
    said = words.where(F.col("word").isin(*firsts)).join(films.where("quality = 'ok'"), "film_id").where(F.col("year") < known[F.col("word")])
    return said.groupBy("film_id", "title", "year").agg(said_list().alias("words"))


def profanity(films: DataFrame, words: DataFrame, verified: Iterable = (), before: int = PROFANITY_BEFORE, prefilter: Iterable[str] = ("%fuck%", "%shit%", "cunt%"), pattern: str = STRONG_PROFANITY) -> DataFrame:
    """(film_id, title, year, hits, words, verified): ok English films from before a year with strong profanity. A
    cheap LIKE goes before the full pattern."""
    like = F.lit(False)
    for p in prefilter:
        like = like | F.col("word").like(p)
    chosen = films.where((F.col("quality") == "ok") & (F.col("lang") == "en") & (F.col("year") < before)).select("film_id", "title", "year")
    said = words.where(like & F.col("word").rlike(pattern)).join(chosen, "film_id")
    verified = tuple(verified)
    return said.groupBy("film_id", "title", "year").agg(F.sum("count").alias("hits"), said_list().alias("words")).withColumn("verified", F.col("film_id").isin(*verified) if verified else F.lit(False))


def odd_rates(films: DataFrame) -> DataFrame:
    ok = films.where((F.col("quality") == "ok") & F.col("words_per_minute").isNotNull())
    return ok.where(implausible_rate(F.col("words_per_minute"), F.col("year"), F.col("genres"))).select("film_id", "title", "year", F.round("words_per_minute", 1).alias("wpm"), "total_words")


def silent_rates(films: DataFrame) -> DataFrame:
    ok = films.where((F.col("quality") == "ok") & (F.col("year") < SILENT_BEFORE) & (F.col("words_per_minute") > SILENT_RATE))
    return ok.select("film_id", "title", "year", F.round("words_per_minute", 1).alias("wpm"), "total_words")


def grey_zone(films: DataFrame, scores: DataFrame, low: float = 0.4, high: float = 0.8) -> DataFrame:
    """Ok English films whose style score is just under the threshold."""
    near = scores.where((F.col("mt_score") >= low) & (F.col("mt_score") < high))
    return films.where("quality = 'ok' AND lang = 'en'").join(near, "film_id").select("film_id", "title", "year", F.round("mt_score", 3).alias("mt_score"))


def known_cases(films: DataFrame, words: DataFrame, ids: Iterable, stopwords: Iterable[str], top: int = 12) -> DataFrame:
    """(film_id, tier, top_words) of films worth watching; those not in the corpus are absent."""
    ids = list(ids)
    asked = films.sparkSession.createDataFrame([(i,) for i in ids], films.select("film_id").schema)
    said = words.where(F.col("film_id").isin(*ids) & (F.length("word") > 3)).withColumn("r", F.row_number().over(Window.partitionBy("film_id").orderBy(F.desc("count"), "word"))).where("r <= 60")
    said = said.where(~F.col("word").isin(*stopwords)).withColumn("k", F.row_number().over(Window.partitionBy("film_id").orderBy("r"))).where(F.col("k") <= top)
    listed = said.groupBy("film_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda e: e["word"]), " ").alias("top_words"))
    return asked.join(films.select("film_id", F.col("quality").alias("tier")), "film_id", "left").join(listed, "film_id", "left").select("film_id", F.coalesce("tier", F.lit("absent")).alias("tier"), F.coalesce("top_words", F.lit("")).alias("top_words"))


def baseline_diff(now: DataFrame, before: DataFrame, key: str = "film_id") -> DataFrame:
    """(key, change): keys that are new, and keys that are gone."""
    a, b = now.select(key).distinct(), before.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("change", F.lit("new")).unionByName(b.join(a, key, "left_anti").withColumn("change", F.lit("gone")))


def audited_films(selection: DataFrame, curated: DataFrame, languages: DataFrame, stats: DataFrame) -> DataFrame:
    """The films that have a chosen file, with its tier, flags and reason, what is known of the film, and its figures,
    null where there are none. Selections from before there were tiers count as ok."""
    chosen = selection
    if "tier" not in selection.columns:
        chosen = selection.withColumns({"tier": F.lit("ok"), "flags": F.array().cast("array<string>")})
    out = chosen.select("film_id", F.coalesce("tier", F.lit("ok")).alias("quality"), F.col("flags").alias("quality_flags"), "reason", "name")
    out = out.join(curated.select("film_id", "title", "year", "genres", "runtime_minutes"), "film_id")
    out = out.join(languages.select("film_id", "lang"), "film_id", "left")
    return out.join(stats.select("film_id", "total_words", "words_per_minute"), "film_id", "left")


CANARIES = ("profanity", "anachronisms", "rates", "silent_rates", "grey_zone")


def findings(
    films: DataFrame, words: DataFrame, scores: DataFrame | None = None, verified: DataFrame | None = None, first_years: dict[str, int] | None = None,
    prefilter: Iterable[str] = ("%fuck%", "%shit%", "cunt%"), pattern: str = STRONG_PROFANITY, before: int = PROFANITY_BEFORE, grey: tuple[float, float] = (0.4, 0.8),
) -> DataFrame:
    """(canary, film_id, title, year, figures) of all checks, from one pass over the films and one over the words; figures
    is a map of what a check has to say.

    films as `audited_films` gives them; scores(film_id, mt_score), verified(film_id), whose early swearing is known to
    be genuine. Only films of tier ok are checked.
    """
    firsts = first_years or FIRST_YEARS
    since = F.create_map(*[F.lit(x) for kv in firsts.items() for x in kv])
    like = F.lit(False)
    for p in prefilter:
        like = like | F.col("word").like(p)
    ok = films.where(F.col("quality") == "ok")
    ages = ok.select("film_id", "lang", "year")
    suspects = words.where(F.col("word").isin(*firsts) | (like & F.col("word").rlike(pattern))).join(ages, "film_id")
    early = F.col("word").isin(*firsts) & (F.col("year") < F.try_element_at(since, F.col("word")))
    rude = like & F.col("word").rlike(pattern) & (F.col("lang") == "en") & (F.col("year") < before)
    entry = F.struct((-F.col("count")).alias("o"), F.col("word").alias("w"), F.concat("word", F.lit(" x"), F.col("count").cast("string")).alias("s"))
    listed = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, entry))), lambda e: e["s"]), ", ")
    said = suspects.where(early | rude).groupBy("film_id").agg(listed(early).alias("_early"), listed(rude).alias("_rude"), F.sum(F.when(rude, F.col("count"))).alias("_hits"))

    out = ok.select("film_id", "title", "year", "genres", "lang", "words_per_minute", "total_words").join(said, "film_id", "left")
    out = out.join(scores.select("film_id", "mt_score"), "film_id", "left") if scores is not None else out.withColumn("mt_score", F.lit(None).cast("double"))
    known = verified.select("film_id").distinct().withColumn("_known", F.lit(True)) if verified is not None else None
    out = out.join(known, "film_id", "left") if known is not None else out.withColumn("_known", F.lit(None).cast("boolean"))
    wpm, year = F.col("words_per_minute"), F.col("year")
    text = lambda **parts: F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v.cast("string"))])
    speed = text(wpm=F.round(wpm, 1), total_words=F.col("total_words"))
    checks = {
        "profanity": (F.col("_hits") > 0, text(hits=F.col("_hits"), words=F.col("_rude"), verified=F.coalesce("_known", F.lit(False)))),
        "anachronisms": (F.col("_early") != "", text(words=F.col("_early"))),
        "rates": (implausible_rate(wpm, year, F.col("genres")), speed),
        "silent_rates": ((year < SILENT_BEFORE) & (wpm > SILENT_RATE), speed),
        "grey_zone": ((F.col("lang") == "en") & (F.col("mt_score") >= grey[0]) & (F.col("mt_score") < grey[1]), text(mt_score=F.round("mt_score", 3))),
    }
    raised = F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("canary"), figures.alias("figures"))) for name, (when, figures) in checks.items()])
    found = out.select("film_id", "title", "year", F.inline(F.filter(raised, lambda x: x.isNotNull())))
    return found.select("canary", "film_id", "title", "year", "figures")


def against_baseline(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """found with change: new, same, or, as rows of the baseline's, gone. A baseline is an earlier run's findings."""
    old = baseline.select("canary", "film_id", F.struct("title", "year", "figures").alias("_old")).dropDuplicates(["canary", "film_id"])
    now = found.select("canary", "film_id", F.struct("title", "year", "figures").alias("_now"))
    row = F.coalesce("_now", "_old")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_now").isNull(), "gone").otherwise("same")
    return now.join(old, ["canary", "film_id"], "full").select("canary", "film_id", row["title"].alias("title"), row["year"].alias("year"), row["figures"].alias("figures"), change.alias("change"))


def tally(compared: DataFrame) -> DataFrame:
    """(canary, findings, new, gone), a row for every check, also those that found nothing."""
    n = lambda c: F.count(F.when(c, 1))
    sums = compared.groupBy("canary").agg(n(F.col("change") != "gone").alias("findings"), n(F.col("change") == "new").alias("new"), n(F.col("change") == "gone").alias("gone"))
    names = compared.sparkSession.createDataFrame([(c,) for c in CANARIES], "canary string")
    zero = F.lit(0).cast("long")
    return names.join(sums, "canary", "left").select("canary", *[F.coalesce(c, zero).alias(c) for c in ("findings", "new", "gone")])


def report(compared: DataFrame, top: int = 200) -> str:
    """Compared findings as text: how many of each check, the changes, and the first rows. Two jobs, of which the second
    takes at most `top` rows of a check."""
    order = Window.partitionBy("canary").orderBy("year", "film_id")
    shown = compared.where("change <> 'gone'").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    rows: dict[str, list[str]] = {}
    for r in shown.orderBy("canary", "_r").collect():
        rows.setdefault(r.canary, []).append(f"- {r.year} {r.title} ({r.film_id}): " + ", ".join(f"{k}={v}" for k, v in sorted(r.figures.items())))
    lines = ["# Corpus audit"]
    for t in sorted(tally(compared).collect(), key=lambda t: CANARIES.index(t.canary)):
        own = rows.get(t.canary, [])
        lines += ["", f"## {t.canary}: {t.findings}", f"vs baseline: +{t.new} new, -{t.gone} gone", *own]
        if t.findings > len(own):
            lines.append(f"- and {t.findings - len(own)} more")
    return "\n".join(lines)


def rare_words(words: DataFrame, min_count: int = 10, min_films: int = 2, max_films: int = 20, top: int = 30) -> DataFrame:
    """(film_id, word): each film's most said words among those of a few films."""
    df = words.groupBy("word").agg(F.count("*").alias("films")).where(F.col("films").between(min_films, max_films)).select("word")
    said = words.where(F.col("count") >= min_count).join(df, "word", "left_semi")
    return said.withColumn("r", F.row_number().over(Window.partitionBy("film_id").orderBy(F.desc("count"), "word"))).where(F.col("r") <= top).select("film_id", "word")


def suspect_pairs(words: DataFrame, min_shared: int = 8, **rare) -> DataFrame:
    """(a, b, shared): films that share many rare words. A rare word is in at most max_films films, which bounds the
    pairs it can give."""
    said = rare_words(words, **rare).groupBy("word").agg(F.array_sort(F.collect_list("film_id")).alias("_films"))
    firsts = said.select("_films", F.posexplode("_films").alias("_at", "a"))
    pairs = firsts.select("a", F.explode(F.slice("_films", F.col("_at") + 2, F.size("_films"))).alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)


def twin_films(words: DataFrame, min_cosine: float = 0.95, min_shared: int = 8, **rare) -> DataFrame:
    pairs = written(suspect_pairs(words, min_shared, **rare), "pairs")
    return pair_cosines(words, pairs).where(F.col("cosine") >= min_cosine)


def directory_consensus(files: DataFrame, chosen: DataFrame, agree: float = 0.8) -> DataFrame:
    """(film_id, consensus): the share of a film's other files(film_id, name, word, count) that agree with the chosen
    one; 1 where there are none."""
    own = chosen.select("film_id", F.col("name").alias("picked"))
    laid = files.repartition(F.col("film_id")).join(own, "film_id").select("film_id", "name", "word", F.col("count").cast("double").alias("c"), (F.col("name") == F.col("picked")).alias("own"))
    within = lambda *keys: Window.partitionBy(*keys)  # noqa: E731  # films lie together: one shuffle serves all of this
    said = laid.withColumn("p", F.max(F.when(F.col("own"), F.col("c"))).over(within("film_id", "word")))
    sums = said.groupBy("film_id", "name").agg(F.sum(F.col("c") * F.col("c")).alias("n2"), F.sum(F.col("c") * F.col("p")).alias("dot"), F.max("own").alias("own"))
    others = sums.withColumn("p2", F.max(F.when(F.col("own"), F.col("n2"))).over(within("film_id"))).where(~F.col("own"))
    cosine = F.coalesce(F.col("dot") / F.nullif(F.sqrt("n2") * F.sqrt("p2"), F.lit(0.0)), F.lit(0.0))
    others = others.withColumn("cosine", cosine)
    shares = others.groupBy("film_id").agg(F.avg(F.when(F.col("cosine") >= agree, 1.0).otherwise(0.0)).alias("consensus"))
    return own.select("film_id").join(shares, "film_id", "left").select("film_id", F.coalesce("consensus", F.lit(1.0)).alias("consensus"))


def victim(consensus_a: Column, consensus_b: Column) -> Column:
    """Which of a pair is mislabelled: the one its own directory disagrees with; null if that isn't clear."""
    return F.when((consensus_a >= 0.8) & (consensus_b < 0.5), 1).when((consensus_b >= 0.8) & (consensus_a < 0.5), 0)


def cast_across_films(words: DataFrame, casts: DataFrame, zipf: DataFrame, max_films: int = 3, max_zipf: float = 3.0, min_other: int = 3, max_own: int = 0) -> DataFrame:
    """(film_id, own, other_id, other, tokens): films that name another film's cast, and not their own.

    words(film_id, word) are a film's content words, casts(film_id, word) its cast's name tokens; only tokens of few
    casts that are rare as words tell films apart.
    """
    rare = casts.groupBy("word").agg(F.count_distinct("film_id").alias("n")).where(F.col("n") <= max_films).join(zipf, "word", "left").where(F.coalesce("zipf", F.lit(0.0)) < max_zipf).select("word")
    owners = casts.select("word", F.col("film_id").alias("other_id")).distinct().join(rare, "word", "left_semi")
    said = words.select("film_id", "word").distinct()
    hits = said.join(owners, "word").where("film_id <> other_id").groupBy("film_id", "other_id").agg(F.count("*").alias("other"), F.array_join(F.array_sort(F.collect_list("word")), " ").alias("tokens"))
    best = hits.withColumn("_r", F.row_number().over(Window.partitionBy("film_id").orderBy(F.desc("other"), "other_id"))).where("_r = 1").drop("_r").where(F.col("other") >= min_other)
    own = said.join(casts.select("film_id", "word").distinct(), ["film_id", "word"]).groupBy("film_id").agg(F.count("*").alias("own"))
    return best.join(own, "film_id", "left").withColumn("own", F.coalesce("own", F.lit(0))).where(F.col("own") <= max_own).select("film_id", "own", "other_id", "other", "tokens")
