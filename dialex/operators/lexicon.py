"""Parts of speech and frequencies of words from the tables of a lexicon.

A lexicon is three tables: senses(synset, pos, lemma, count), a row for each word of a set of synonyms, with how often a
tagged corpus uses it so; exceptions(form, pos, lemma), irregular forms; and frequencies(word, zipf). Everything is joins:
no lexicon is held by a task, and none is looked up word by word.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialex.sources.scratch import scratch

# Parts of speech in order, and the endings that each may have lost or changed.
POS = ("n", "v", "a", "r")
ENDINGS: dict[str, tuple[tuple[str, str], ...]] = {
    "n": (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")),
    "v": (("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")),
    "a": (("er", ""), ("est", ""), ("er", "e"), ("est", "e")),
    "r": (),
}
#: A word as common as this that no tagged text uses is known to the lexicon as something else only.
COMMON = 5.0
#: How many endings a word may have lost one after the other.
ROUNDS = 3


def _pos_place(pos: Column) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in POS]), pos)


def _shorter(forms: DataFrame) -> DataFrame:
    """(word, pos, form, place): the forms that forms(word, pos, form) may come from by one ending; place orders them."""
    rules = [(pos, old, new, i) for pos in POS for i, (old, new) in enumerate(ENDINGS[pos])]
    table = forms.sparkSession.createDataFrame(rules, "pos string, old string, new string, place int")
    cut = forms.join(F.broadcast(table), "pos").where(F.endswith("form", "old"))
    return cut.select("word", "pos", F.concat(F.expr("left(form, length(form) - length(old))"), F.col("new")).alias("form"), "place")


def base_forms(words: DataFrame, senses: DataFrame, exceptions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(word, pos, form, place): the lexicon's words that a word may be a form of, the likeliest at the smallest place.

    A word that the lexicon has, and what its irregular forms or else one lost ending leave, stand together; where none
    of them is in the lexicon, two lost endings are tried, and so on.
    """
    known = senses.select(F.lower("lemma").alias("form"), _folded("pos").alias("pos")).distinct()
    asked = words.select("word").distinct().withColumn("pos", F.explode(F.array(*[F.lit(p) for p in POS])))
    irregular = exceptions.select(F.col("form").alias("word"), _folded("pos").alias("pos"), F.lower("lemma").alias("form")).distinct()
    own = asked.select("word", "pos", F.col("word").alias("form"), F.lit(-1).alias("place"))
    odd = asked.join(irregular, ["word", "pos"]).select("word", "pos", "form", F.dense_rank().over(Window.partitionBy("word", "pos").orderBy("form")).alias("place"))
    regular = asked.join(irregular.select("word", "pos").distinct(), ["word", "pos"], "left_anti")
    tried = _shorter(regular.withColumn("form", F.col("word")))
    found = own.unionByName(odd).unionByName(tried).join(known, ["form", "pos"], "left_semi").withColumn("round", F.lit(1))
    for n in range(2, rounds + 1):
        tried = _shorter(tried.select("word", "pos", "form").distinct())
        found = found.unionByName(tried.join(known, ["form", "pos"], "left_semi").withColumn("round", F.lit(n)))
    first = F.min("round").over(Window.partitionBy("word", "pos"))
    kept = found.withColumn("_first", first).where(F.col("round") == F.col("_first"))
    return kept.groupBy("word", "pos", "form").agg(F.min("place").alias("place"))


def _folded(pos: str) -> Column:
    """Satellites of adjectives are adjectives."""
    return F.when(F.col(pos) == "s", "a").otherwise(F.col(pos))


def dominant_pos(words: DataFrame, senses: DataFrame, exceptions: DataFrame, discourse: Iterable[str] = (), rounds: int = ROUNDS) -> DataFrame:
    """(word, classes, pos) of words(word, zipf): all parts of speech that a word can be, and the one it mostly is.

    That is the part of speech whose base form's uses add up to the most, the first in order in a tie. Only uses of the
    base form as it is written count, so those of a name don't. Of a word without any use it is the first that the
    lexicon has, but for common words, which are x; so are words that the lexicon lacks, and those of `discourse`,
    which lexicons take for something else.
    """
    path = scratch(words.sparkSession, "forms")  # they are needed twice, and took several joins
    base_forms(words, senses, exceptions, rounds).write.parquet(path)
    forms = words.sparkSession.read.parquet(path)
    place = Window.partitionBy("word", "pos").orderBy("place", "form")
    base = forms.withColumn("_r", F.row_number().over(place)).where("_r = 1").select("word", "pos", F.col("form").alias("base"))
    index = senses.select(F.lower("lemma").alias("form"), _folded("pos").alias("pos"), "synset").distinct()
    synsets = forms.join(index, ["form", "pos"]).select("word", "pos", "synset").distinct()
    uses = senses.groupBy("synset", F.col("lemma").alias("base")).agg(F.sum("count").alias("uses"))
    summed = synsets.join(base, ["word", "pos"]).join(uses, ["synset", "base"], "left").groupBy("word", "pos").agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("uses"))
    placed = summed.withColumn("p", _pos_place(F.col("pos")))
    best = placed.groupBy("word").agg(F.min(F.struct((-F.col("uses")).alias("u"), "p", "pos")).alias("b"), F.array_sort(F.collect_set(F.struct("p", "pos"))).alias("all"))
    classes = F.array_join(F.transform("all", lambda x: x["pos"]), "")
    judged = words.select("word", "zipf").distinct().join(best, "word", "left")
    none = F.col("b").isNull() | (F.col("word").isin(*discourse) if (discourse := tuple(discourse)) else F.lit(False))
    pos = F.when(none, "x").when(F.col("b.u") < 0, F.col("b.pos")).when(F.coalesce("zipf", F.lit(0.0)) >= COMMON, "x").otherwise(F.col("b.pos"))
    return judged.select("word", F.when(F.col("b").isNull(), "x").otherwise(classes).alias("classes"), pos.alias("pos"))


def split_by_lexicon(word: Column, endings: Iterable[str] = ("n't", "'s", "'re", "'ll", "'m", "'ve", "'d")) -> Column:
    """Whether a lexicon counts a word as several: an apostrophe inside it parts it, unless a contracted ending begins
    there."""
    tail = F.lit(False)
    for e in endings:
        tail = tail | (word.endswith(e) & ~F.substr(word, F.lit(1), F.length(word) - len(e)).contains("'"))
    return F.btrim(word, F.lit("'")).contains("'") & ~tail


def frequencies(words: DataFrame, table: DataFrame) -> DataFrame:
    """(word, zipf) of words(word) by a table(word, zipf): 0 for words that it lacks or that the lexicon splits."""
    known = words.select("word").distinct().join(table.select("word", "zipf"), "word", "left")
    return known.select("word", F.when(split_by_lexicon(F.col("word")), 0.0).otherwise(F.coalesce("zipf", F.lit(0.0))).alias("zipf"))


def word_lexicon(words: DataFrame, senses: DataFrame, exceptions: DataFrame, table: DataFrame, discourse: Iterable[str] = ()) -> DataFrame:
    """(word, zipf, classes, pos): what `word_meta` wants to know of words(word)."""
    rated = frequencies(words, table)
    return rated.join(dominant_pos(rated, senses, exceptions, discourse), "word")
