"""Token alignment, hard negatives and exact top-k against brute-force versions, and their edge cases."""

import bisect
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelspark.llm import alignment, hard_negatives, queries, topk, vectors

# 11
ODD = ["", None, " ", "  two  spaces ", "a", "é▁x", "▁", "\n\n \n\nx\t y", "a\n \n\nx b", "𝄞 ü 日本語 テキスト", "<|endoftext|> <s> </s> <unk>", "x" * 5_000, "don't you'll I'M 12,345.6", "\x00 a", "a \x1c b", "w " * 3_000, "  a  b"]


def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.A_VOCABULARY)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.B_VOCABULARY)

    def one(text):
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        p = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        q = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        whole = (" " + text).encode()
        return (x, y, p, q) if b"".join(p) == whole == b"".join(q) else None
    return one


def brute(texts):
    """Measures of each text, straight from the definition."""
    encode, found, counts = encoders(), [], Counter()
    for t in texts:
        got = encode(t) if t else None
        if got is None:
            found.append(None)
            continue
        x, y, p, q = got
        span = lambda parts: [(s, s + len(x)) for s, x in zip(np.cumsum([0, *map(len, parts)]).tolist(), parts)]
        a, b = span(p), span(q)
        pairs, j = [], 0
        for i, (s, e) in enumerate(a):
            while b[j][1] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][0] < e:
                pairs.append((x[i], y[k]))
                k += 1
        both = sorted({e for _, e in a} & {e for _, e in b})
        ga, gb = [[] for _ in both], [[] for _ in both]
        for spans, ids, out in ((a, x, ga), (b, y, gb)):
            for (_, e), i in zip(spans, ids):
                out[bisect.bisect_left(both, e)].append(i)
        groups = ";".join(",".join(map(str, m)) + "|" + ",".join(map(str, n)) for m, n in zip(ga, gb))
        counts.update(pairs)
        found.append((len(x), len(y), len(both), pairs, hashlib.sha256(groups.encode()).hexdigest()))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(n, best.get(j, 0))
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(counts[p] == best[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), f[4]) for f in found]


@pytest.mark.parametrize("broadcast", [10**6, 40])
def test_alignment_is_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", broadcast)
    rng = random.Random(3)
    words = ["the", "house", "Größe", "of", "42", "end.", "naïve", "tokenizer", "x1y2"]
    texts = ODD + [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(12)]
    texts += texts[-3:] * 4  # copies
    rows = spark.createDataFrame([(i, t, b"1", i) for i, t in enumerate(texts)], "doc_id long, text string, digest binary, id int").repartition(3)
    got = {r.id: tuple(r)[1:] for r in alignment.aligned(rows).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_alignment_edges(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), ("2", None)] if False else [(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted(alignment.aligned(rows).collect(), key=lambda r: (r.id or 0, r.n_a))
    assert [r.id for r in got] == [None, 1, 1, 2] and len({tuple(r)[1:] for r in got[:3]}) == 1 and got[3].groups_sha256 == "" and got[3].n_a == 0
    assert got[0].count_sum == 3 * got[0].n_links and got[0].n_best == got[0].n_links
    pair = alignment.Pair(open(alignment.A_VOCABULARY, "rb").read(), open(alignment.B_VOCABULARY, "rb").read())
    assert pair.a.fast and pair.b.by_word
    texts = [t for t in ODD if t]
    want = [None if f is None else (*f[:5], f[5].tolist(), f[6].tolist()) for f in pair.aligned(texts)]
    pair.a.fast, pair.split = None, lambda t: [t]  # the other encoder and whole texts give the same
    pair.forget()
    assert [None if f is None else (*f[:5], f[5].tolist(), f[6].tolist()) for f in pair.aligned(texts)] == want
    monkeypatch.setattr(alignment, "UNITS", 3)  # a task that forgets
    assert [None if f is None else f[4] for t in texts for f in pair.aligned([t])] == [w and w[4] for w in want]


def test_alignment_of_the_table(spark):
    """The query over the whole table against the definition."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in queries.op11_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(zip([d.doc_id for d in docs], brute([d.text for d in docs])))


# 12 and 13
VECTORS = "vec_id long, embedding array<float>, label int, id string, vec int, block int, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 0, 1, "r") for i, v, l in rows], VECTORS).repartition(3)


def some_vectors(rng, n, width=12):
    """Random vectors, a third of them equal, some of other lengths, zero, null, or with odd components."""
    same = [rng.gauss(0, 0.3) for _ in range(width)]
    rows = [(i, same if i % 3 == 0 else [rng.gauss(0, 0.3) for _ in range(width)], rng.randrange(3)) for i in range(n)]
    rows += [(n, [0.0] * width, 1), (n + 1, None, 1), (n + 2, [0.1, None] + [0.1] * 3, 2), (n + 3, [math.nan] * width, 0), (n + 4, [math.inf] * width, 0), (n + 5, [0.5, 0.25], 0), (n + 6, [], 2),
             (n + 7, [0.2] * (width + 3), 1), (None, same, 1), (n + 8, same, None), (n + 9, [-0.001] * width, 2)]
    return rows


def whole(rows, labelled=False):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], l) for i, v, l in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and not (labelled and l is None)]
    return ok


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


@pytest.mark.parametrize("least", [2_048, 10])
def test_topk_is_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(vectors, "LEAST_BLOCK", least)
    rows = some_vectors(random.Random(5), 130)
    ok = whole(rows)
    want = {(i, r + 1, j, s) for i, v, _ in ok if i % 5 == 0 or i > 129 for r, (s, j) in enumerate(sorted(((dot(v, w), j) for j, w, _ in ok if j != i), key=lambda x: (-x[0], x[1]))[:5])}
    df = table(spark, rows)
    got = [tuple(r) for r in topk.search(df, df.where("vec_id % 5 = 0 or vec_id > 129"), 5).collect()]
    assert set(got) == want and len(got) == len(want)


def test_topk_reads_only_part_of_the_lists():
    rng = np.random.default_rng(1)
    x = rng.integers(-40, 40, (4_000, 8))
    x[:10] += 200
    rows = pa.table({"id": np.arange(4_000), "vec": pa.array(x.tolist(), pa.list_(pa.int64()))})
    tile = topk.Lists(rows)
    ids, score, depth = topk.top(tile, x[:1], np.array([0]), 5)[0]
    exact = x @ x[0]
    exact[0] = -(2**60)
    assert score.tolist() == sorted(exact.tolist(), reverse=True)[:5] and (exact[ids] == score).all() and depth < 2_000
    assert topk.top(tile, np.zeros((1, 8), np.int64), np.array([3]), 5)[0][0].tolist() == [0, 1, 2, 4, 5]
    big = np.array([[2**31, 5], [2**31, -5], [-(2**31), 2**20], [7, 0]])
    huge = topk.Lists(pa.table({"id": np.arange(4), "vec": pa.array(big.tolist(), pa.list_(pa.int64()))}))
    assert topk.top(huge, np.array([[2**20, 3]]), np.array([9]), 2)[0][1].tolist() == [2**51 + 15, 2**51 - 15]
    ties = topk.Lists(pa.table({"id": np.arange(900)[::-1].copy(), "vec": pa.array([[5, -5]] * 900, pa.list_(pa.int64()))}))
    assert topk.top(ties, np.array([[1, -1]]), np.array([1]), 3)[0][0].tolist() == [0, 2, 3]


def test_topk_edges(spark):
    empty = table(spark, [])
    one = table(spark, [(7, [1.0, 2.0], 0), (7, [1.0, 1.0], 0), (7, [1.0, 1.0], 0), (8, [1.0, 0.0], 0), (8, [1.0, 0.0], 0)])
    assert topk.search(empty, empty).count() == 0 and topk.search(empty, one).count() == 0 and topk.search(one, empty).count() == 0
    got = sorted(tuple(r) for r in topk.search(one, one, 5).collect())
    assert got == [(7, 1, 8, 65536), (7, 2, 8, 65536), (8, 1, 7, 65536), (8, 2, 7, 65536), (8, 3, 7, 65536)]  # repeated ids: candidates each, asked once


def hard(rows, anchors, k, n, least=30, most=90):
    ok, out = whole(rows, True), set()
    for i, v, l in ok:
        if not anchors(i):
            continue
        for p, j in sorted(((dot(v, w), j) for j, w, m in ok if m == l and j != i), key=lambda x: (-x[0], x[1]))[:k]:
            near = sorted(((dot(v, w), x) for x, w, m in ok if m != l and least * p <= 100 * dot(v, w) <= most * p), key=lambda x: (-x[0], x[1]))[:n]
            out |= {(i, j, r + 1, x, p, s) for r, (s, x) in enumerate(near)}
    return out


@pytest.mark.parametrize("least", [2_048, 10])
def test_hard_negatives_are_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(vectors, "LEAST_BLOCK", least)
    rows = some_vectors(random.Random(6), 140)
    want = hard(rows, lambda i: i % 4 == 0, 3, 6)
    got = [tuple(r) for r in hard_negatives.mine(table(spark, rows), F.col("vec_id") % 4 == 0, F.col("label"), 3, 6).collect()]
    assert set(got) == want and len(got) == len(want) and len({r[4] for r in want if r[4] <= 0}) <= 1


def test_intervals_hold_every_score():
    rng = np.random.default_rng(2)
    for width in (1, 3, 64, 70):
        x = rng.integers(-300, 300, (400, width)) * (rng.random((400, 1)) < 0.95)
        tile = hard_negatives.Codes(pa.table({"id": np.arange(400), "label": np.arange(400) % 3, "vec": pa.array(x.tolist(), pa.list_(pa.int64()))}))
        for q in (x[0], x[7], np.zeros(width, np.int64), rng.integers(-9, 9, width)):
            low, high = tile.interval(q)
            assert (low <= x @ q).all() and (x @ q <= high).all()
    # where labels are clusters the codes leave little to score
    base = rng.normal(size=(10, 64)) * 60
    x = np.rint(base[np.arange(4_000) % 10] + rng.normal(size=(4_000, 64)) * 3).astype(np.int64)
    tile = hard_negatives.Codes(pa.table({"id": np.arange(4_000), "label": np.arange(4_000) % 10, "vec": pa.array(x.tolist(), pa.list_(pa.int64()))}))
    low, high = tile.interval(x[0])
    assert (high >= np.sort(low)[-5]).sum() < 1_200


def test_hard_negatives_edges(spark):
    mine = lambda rows: hard_negatives.mine(table(spark, rows), F.col("vec_id") % 100 == 0, F.col("label")).collect()
    assert mine([]) == [] and mine([(0, [1.0], 0)]) == [] and mine([(0, [1.0], 0), (1, [1.0], 1)]) == []
    assert mine([(0, [1.0], 0), (1, [-1.0], 0), (2, [-0.5], 1)]) == []  # a negative positive score has no range
    got = mine([(0, [1.0], 0), (1, [1.0], 0), (2, [0.5], 1), (2, [0.5], 1), (3, [0.95], 1), (4, [0.2], 1)])
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 2, 65536, 32768), (0, 1, 2, 2, 65536, 32768)]  # repeated rows are candidates each
