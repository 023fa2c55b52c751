import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dialex.llm import quality, simhash


def labelled(n=400, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9)))
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        words = [word() for _ in range(rng.randint(20, 120))]
        text = " ".join(words).capitalize() + "." if good else rng.choice([" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join([words[0]] * 60)])
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(good)))
    return rows, labels


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows, labels = labelled()
    rows += [(i + 1000, rows[i][1], "en", "s1", rows[i][4]) for i in range(1, 60, 3)]  # exact copies of good documents
    rows += [(i + 2000, rows[i][1].replace(" ", "  ", 1) + " end", "en", "s2", 1) for i in range(2, 30, 3)]  # near copies
    rows += [(None, "A text without an id, but a good one all the same.", None, None, 5), (3000, None, "en", "s1", 0), (3001, "", "en", "s1", 0)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder), rows, dict(labels)


def test_classifier_holds_out_and_learns(spark, corpus):
    folder, rows, labels = corpus
    got = {r.doc_id: r for r in quality.op10_quality(spark, folder).collect()}
    assert set(got) == {r[0] for r in rows}
    import zlib

    for d in labels:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= got[d].score <= 1
        assert got[d].predicted == int(got[d].score >= 0.5)
    unseen = [d for d in labels if got[d].held_out]
    assert sum(got[d].predicted == labels[d] for d in unseen) >= 0.95 * len(unseen)


def test_scores_depend_on_texts_only(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.quality_model(spark, docs, folder)
    a = {r.doc_id: r.score for r in quality.score(docs, model, F.col("doc_id")).collect()}
    b = {r.doc_id: r.score for r in quality.score(docs.withColumns({"source": F.lit("x"), "lang": F.lit("y"), "score": F.lit(9.0)}), model, F.col("doc_id")).collect()}
    assert a == b
    again = quality.quality_model(spark, docs.repartition(5), folder)
    assert {r.doc_id: r.score for r in quality.score(docs, again, F.col("doc_id")).collect()} == a


def test_no_labels_or_one_class(spark, empty):
    none = spark.createDataFrame([], "doc_id long, label int")
    model = quality.train(empty, none)
    assert model.scores(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]
    ones = quality.fit(np.random.default_rng(1).random((5, 3)), np.ones(5))
    assert (ones.scores(np.zeros((1, 3))) > 0.5).all()
    assert quality.score(empty, model, F.col("doc_id")).count() == 0


def test_pair_tables_learn_what_single_ones_cannot():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert (quality.fit(x, y, pairs=0).scores(x).round() == y).mean() < 0.75
    assert (quality.fit(x, y).scores(x).round() == y).mean() > 0.9


def test_describe_takes_any_text():
    for t in ("", " ", "\n", "x", "é" * 5000, "a\x00b", "|" * 30):
        assert len(quality.describe(t)) == len(quality.FEATURES) and np.isfinite(quality.describe(t)).all()


def test_every_stage(spark, corpus):
    folder, rows, labels = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    kept = corpus_pipeline.classify(spark, docs, folder).cache()
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not [d for d, q in labels.items() if q and d not in ids] and len([d for d, q in labels.items() if not q and d in ids]) <= 2

    lines = corpus_pipeline.drop_lines(spark, kept, folder).cache()
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for r in kept.collect():
        for x in (r.text or "").split("\n") if r.doc_id is not None else []:
            first[key(x)] = min(first.get(key(x), r.doc_id), r.doc_id)
    expected = {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if r.doc_id is None or len(key(x)) < 10 or first[key(x)] == r.doc_id) for r in kept.collect()}
    assert {r.doc_id: r.text for r in lines.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    for source in (docs, lines):  # near copies are gone, one of each group stays
        single = corpus_pipeline.drop_near_duplicates(spark, source, folder)
        items = sorted(((r.doc_id, set(simhash.shingle_hashes(simhash.words_of(r.text), 5).tolist())) for r in source.where("doc_id IS NOT NULL").collect()), key=lambda x: x[0])
        from dialex.llm.components import Forest

        f = Forest(len(items))
        for i, (_, a) in enumerate(items):
            for j in range(i):
                if len(a & items[j][1]) >= 0.8 * len(a | items[j][1]):
                    f.join(i, j)
        assert {r.doc_id for r in single.collect()} == {items[i][0] for i in range(len(items)) if f.find(i) == i} | {r.doc_id for r in source.where("doc_id IS NULL").collect()}

    mixed = corpus_pipeline.mix_sources(spark, lines, folder)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    packed = corpus_pipeline.pack_sequences(spark, mixed, folder)
    per_doc = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(r.n == r.t * copies[r.doc_id] for r in per_doc.collect())


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.count() > 0 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_stages_of_an_empty_table(spark, corpus):
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus[0])
        assert out.count() == 0, name
        assert name == "packing" or out.columns == docs.columns


def test_stages_keep_columns_of_any_name_and_rows_that_agree_once(spark, corpus):
    odd = ["_score", "_text", "_kept", "_n_lines", "_id", "_gone", "_bits", "_n", "_copies", "_size", "_nth", "_rank", "_source", "a.b", "count", "component_id"]
    good = "A good document of plain words that is told apart from all the others by what it says about rivers and hills."
    rows = [(1, good), (1, good), (2, good), (3, good + " It also goes on about lakes and so it is another text altogether, longer than the first one was."), (None, good), (None, good), (4, None), (4, "")]
    data = [(i, t, "en", None if i is None else f"s{i % 2}", len(t or ""), *range(len(odd))) for i, t in rows]
    docs = spark.createDataFrame(data, DOCS + ", " + ", ".join(f"`{c}` int" for c in odd))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, corpus[0])
        assert out.columns == docs.columns, name
        got = [r.doc_id for r in out.collect()]
        if name == "near-dedup":  # rows that agree in id and text once; a null text is no empty one; rows without an id stay
            assert sorted(map(str, got)) == ["1", "3", "4", "4", "None", "None"]


def test_near_dedup_judges_rows_that_share_an_id_by_their_texts(spark, corpus):
    """A text that no other row is like stays, whatever else its id holds."""
    say = lambda tag: " ".join(f"{tag}{i}" for i in range(30))
    a, near, b, c = say("a"), say("a") + " more", say("b"), say("c")
    rows = [(1, a), (5, a), (5, b), (5, b), (7, near), (7, c), (9, c), (3, near), (9, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).repartition(3)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, corpus[0])
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, a), (5, b), (7, c)]


def test_source_mix_stage_meets_its_targets(spark, corpus):
    from collections import Counter, defaultdict

    from tests.llm.test_mixing_lines import targets

    rng = random.Random(3)
    rows = [(None if i % 50 == 0 else i // (2 if i % 9 == 0 else 1), "w " * rng.randint(0, 30), "en", rng.choice(["a", "b", "b", "b", None]), i) for i in range(500)]
    size = lambda t: len((t or "").split())
    got = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, DOCS), corpus[0]).collect()
    copies = Counter((r.n_chars, r.source) for r in got)
    assert max(copies.values()) <= 3
    sums, taken = defaultdict(int), defaultdict(int)
    for _, t, _, s, _ in rows:
        sums[s] += size(t)
    for r in got:
        taken[r.source] += size(r.text)
    for s, goal in targets(sums).items():
        assert abs(taken[s] - goal) <= 15 + 1e-9  # half the longest document at most
