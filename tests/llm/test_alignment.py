"""Token alignment against a plain reading of its definition, text by text."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from dialex.llm import alignment
from dialex.llm.tokens import load, tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def tools():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(tokenizer_path(A)), load(B)
    a.encode_special_tokens = True
    return a, b


def spans(tools, text):
    """(id, bytes) of both kinds, or two empty lists where the bytes aren't the text's."""
    if not text:
        return [], []
    a, b = tools
    char = alignment._byte_chars()
    assert sorted(char.values()) == list(range(256))
    e = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(char[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
    right = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    want = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == want == b"".join(x for _, x in right) else ([], [])


def groups_of(tools, text):
    left, right = spans(tools, text)
    found, i, j = [], 0, 0
    while i < len(left):
        a, b, na, nb = [left[i][0]], [right[j][0]], len(left[i][1]), len(right[j][1])
        i, j = i + 1, j + 1
        while na != nb:
            if na < nb:
                a.append(left[i][0])
                na, i = na + len(left[i][1]), i + 1
            else:
                b.append(right[j][0])
                nb, j = nb + len(right[j][1]), j + 1
        found.append((a, b))
    return found


def brute_force(tools, rows):
    grouped = [(d, groups_of(tools, t)) for d, t in rows]
    counts = Counter()
    for _, gs in grouped:
        counts.update({(a, b) for x, y in gs for a in x for b in y})
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    out = []
    for d, gs in grouped:
        links = [(a, b) for x, y in gs for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        out.append((d, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return out


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def key(row):
    return str(tuple(row))


def odd_texts():
    rng = random.Random(11)
    bits = ["a", "the", "unhappy", "tokenization", " ", "  ", "\n", "\t", "\x1c", "\x00", "▁", "é", "ﬁ", "日本語", "🙂", "don't", "x" * 40, "<s>", "<|endoftext|>", "<0x41>", "12345", "...", " ", "　", "_", "//", "\r\n", "\x85"]
    return ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 25))) for _ in range(600)]


def test_odd_texts_equal_brute_force(spark, tools):
    rows = list(enumerate([*odd_texts(), None, "", " ", "   ", "日本" * 3000, "ab " * 4000, "é" * 5000]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got, groups, pairs = alignment.align(docs, A, B)
    assert sorted(map(key, got.select(*COLUMNS).collect())) == sorted(map(key, brute_force(tools, rows)))
    texts = [groups_of(tools, t) for _, t in rows]
    counts = Counter(p for gs in texts for p in {(a, b) for x, y in gs for a in x for b in y})
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == dict(counts)
    of = Counter(g for gs in texts for g in {(tuple(x), tuple(y)) for x, y in gs})
    assert groups.count() == len(of) and sorted(r.docs for r in groups.collect()) == sorted(of.values())


@pytest.mark.parametrize(("keep", "chars", "hot"), [(5, 200, 1), (50, 1000, 40), (10**6, 1 << 21, 0)])
def test_small_memories_and_slices_change_nothing(spark, tools, monkeypatch, keep, chars, hot):
    tool = alignment.Aligner(A, B)
    monkeypatch.setattr(alignment, "KEEP", keep)
    monkeypatch.setattr(alignment, "SLICE_CHARS", chars)
    monkeypatch.setattr(alignment, "CALL_CHARS", chars)
    monkeypatch.setattr(alignment, "_ALIGNERS", {(A, B): tool})
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    texts = odd_texts()[:200]
    schema = to_arrow_schema(spark.createDataFrame([], alignment.SCHEMA.format(id="long")).schema)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["row", "doc_id", "text"])
    rows = [r for b in alignment._align_batches(iter([batch]), A, B, schema) for r in b.to_pylist()]
    want = brute_force(tools, list(enumerate(texts)))
    assert [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in rows if r["kind"] == 0] == [(w[0], *w[1:5], w[7]) for w in want]
    counts = Counter()
    for r in rows:
        if r["kind"] == 1:
            counts.update({(a, b): r["docs"] for a in r["a"] for b in r["b"]})
        elif r["kind"] == 2:
            counts[divmod(r["pair"], 32000)] += r["docs"]
    true = Counter(p for t in texts for p in {(a, b) for x, y in groups_of(tools, t) for a in x for b in y})
    assert counts == true
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = alignment.align(docs, A, B, hot_groups=hot)[0]
    assert sorted(map(key, got.select(*COLUMNS).collect())) == sorted(map(key, want))


def test_hard_rows_and_empty_tables(spark, tools, hard, empty):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    got = alignment.align(hard, A, B)[0]
    assert sorted(map(key, got.select(*COLUMNS).collect())) == sorted(map(key, brute_force(tools, rows)))
    for part in alignment.align(empty, A, B):
        assert part.count() == 0


def test_registered_query_equals_brute_force(spark, tools, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = alignment.op11_token_alignment(spark, sf_dir)
    assert sorted(map(key, got.select(*COLUMNS).collect())) == sorted(map(key, brute_force(tools, [(r.doc_id, r.text) for r in docs.collect()])))


def test_segments_give_the_text_back():
    text = "ab cd  ef\ng " * 50
    parts = list(alignment.segments(text, 20))
    assert len(parts) > 10 and " ".join(parts) == text and all(p[0] != " " for p in parts[1:])
