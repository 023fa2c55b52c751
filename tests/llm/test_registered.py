"""The registered queries, by name, against brute force on a written folder."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__
from dialex.llm import tokens
from tests.llm.conftest import SCHEMA, hard_rows
from tests.llm.test_mixing_lines import brute_lines, check
from tests.llm.test_simhash import components, fingerprint
from tests.llm.test_suffix_dedup import brute
from tests.llm.test_vectors import good, rows_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    pytest.importorskip("public_tokenizers")
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    vectors = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v, *_ in rows_of(2)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3).write.parquet(str(path / "embeddings.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def rows(spark, folder):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def run(spark, folder, name):
    return __spark_entry__.queries()[name](spark, folder)


def tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_suffix_dedup(spark, folder, rows):
    got = run(spark, folder, "op1_suffix_dedup")
    assert tuples(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute([r[:2] for r in rows], 50)


def test_simhash_near_dup(spark, folder, rows):
    named = [(i, fingerprint(t)) for i, t, _ in rows]
    nodes = sorted({f for i, f in named if i is not None})
    roots = components(nodes, lambda a, b: (a ^ b).bit_count() <= 2)
    of = dict(zip(nodes, roots, strict=True))
    least = {}
    for i, f in named:
        if i is not None:
            least[of[f]] = min(least.get(of[f], i), i)
    got = run(spark, folder, "op3_simhash_near_dup")
    assert tuples(got, "doc_id", "fingerprint", "component_id") == sorted(((i, f"{f:016x}", least.get(of.get(f))) for i, f in named), key=str)


def test_token_counts(spark, folder, rows):
    model = tokens.load("piece_bpe_32k.model")
    count = [len(model.encode(t or "")) for _, t, _ in rows]
    want = sorted(((i, len((t or "").encode()), n, n > 4096) for (i, t, _), n in zip(rows, count, strict=True)), key=str)
    assert tuples(run(spark, folder, "op4_token_counts"), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_packing(spark, folder, rows):
    model = tokens.load("word_bpe_49k.json")
    ids = [[*model.encode(t or "", add_special_tokens=False).ids, 1] for _, t, _ in rows]
    got = run(spark, folder, "op5_packing").collect()
    of = defaultdict(list)
    for (i, _, _), x in zip(rows, ids, strict=True):
        of[i].append(x)
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in of[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for i, own in pieces.items():
        assert sum(n for _, n in own) == sum(map(len, of[i])) and Counter(p for s, n in own for p in range(s, s + n)) == Counter(p for x in of[i] for p in range(len(x)))
    assert set(pieces) == set(of)
    for own in places.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= 2048


def test_source_mix(spark, folder, rows):
    class Row:
        def __init__(self, r):
            self.doc_id, self.size, self.source_size, self.target, self.copies = r.doc_id, r["size"], r.source_size, r.target, r.taken // max(r["size"], 1)

    got = run(spark, folder, "op6_source_mix").collect()
    assert all(r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"] for r in got)
    sources = defaultdict(list)
    for i, t, s in rows:
        sources[i, len(tokenised(t))].append(s)
    shaped = []
    for r in got:
        row = Row(r)
        row.source = sources[r.doc_id, r["size"]].pop()
        shaped.append(row)
    longest = Counter()
    for _, t, s in rows:
        longest[s] = max(longest[s], len(tokenised(t)))
    check(rows, shaped, lambda s, t: longest[s] / 2)


def tokenised(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_line_dedup(spark, folder, rows):
    want = sorted(brute_lines([r[:2] for r in rows]).elements(), key=str)
    assert tuples(run(spark, folder, "op7_line_dedup"), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want


def test_vector_near_dup(spark, folder):
    vectors = [(i, v) for i, v, *_ in rows_of(2)]
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if i is not None and good(v)]
    got = {r.vec_id: r for r in run(spark, folder, "op9_vector_near_dup").collect()}
    cosine = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b))) if len(a) == len(b) else -1.0
    links = {i: {j for j, w in fine if j != i and cosine(v, w) >= 0.95} for i, v in fine}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert sum(r.n_links for i, r in got.items() if i in links) >= 0.9 * sum(map(len, links.values()))
    assert all(got[i].n_links <= len(links.get(i, ())) for i in got if i is not None)
