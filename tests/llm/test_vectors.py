"""Whitening, packing and hard negatives against plain versions."""

import math
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from scholia.llm import negatives, packing, whiten  # noqa: E402
from scholia.llm.bpe import default_vocabulary  # noqa: E402

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int, id string, row int, v double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", 1, 0.5) for i, v, k in rows], KIND)


def odd_vectors():
    """Nulls, non-finite and empty vectors, another length, huge entries, repeated rows, a null id and a null label."""
    own = random.Random(4)
    v = lambda: [own.gauss(0, 0.3) for _ in range(6)]
    rows = [(i, v(), i % 3) for i in range(300)]
    rows += [rows[7], rows[100], rows[100], (None, v(), 1), (400, v(), None)]
    rows += [(500, None, 1), (501, [], 1), (502, [math.nan] * 6, 1), (503, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (504, [math.inf] + [0.0] * 5, 1), (505, [1.0] * 5, 1), (506, [1e30] * 6, 1)]
    return rows


def usable(rows):
    return [r for r in rows if r[1] is not None and len(r[1]) == 6 and all(c is not None and math.isfinite(c) and abs(c) < 2**16 for c in r[1])]


def plain_whitening(x):
    """Deviations and the whitened components of integer vectors, with Python integers up to the covariance."""
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[sum(r[i] * r[j] for r in y) / n**3 for j in range(d)] for i in range(d)])
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    return [sum(c * c for c in r) for r in y], np.array(y, float) / n @ w / np.sqrt(e), e / np.trace(v)


def as_float(v):
    return [float(np.float32(c)) for c in v]


@pytest.mark.parametrize("lift", [0.0, 1000.0])
def test_whitening_against_plain_integers(spark, lift):
    rows = [(i, v and [c if c is None else c + lift for c in v], k) for i, v, k in odd_vectors()]
    own = [(i, [math.floor(1024 * c) + 100000 for c in as_float(v)]) for i, v, _ in usable(rows)]
    deviation, white, explained = plain_whitening([x for _, x in own])
    found = whiten.components(vectors(spark, rows), most=8).toPandas()
    assert len(found) == 6 * len(own) and set(found.n) == {len(own)} and found.identity_error.max() < 1e-9
    assert Counter(found.vec_id.fillna(-1)) == Counter({(-1 if i is None else i): 6 * m for i, m in Counter(i for i, _ in own).items()})
    at = {}
    for (i, _), far, w in zip(own, deviation, white):
        at.setdefault(i, (far, w))
    for k in range(6):
        part = found[(found.component == k + 1) & found.vec_id.notna()]
        want = np.array([at[i][1][k] for i in part.vec_id])
        sign = np.sign(part.whitened.iloc[0] * want[0])
        assert np.allclose(part.whitened, sign * want, atol=1e-8) and np.allclose(part.explained, explained[k], rtol=1e-12)
        assert [int(x) for x in part.deviation] == [at[i][0] for i in part.vec_id]


def test_whitening_of_large_entries_is_exact(spark):
    own = random.Random(9)
    rows = [(i, [own.uniform(-1, 1) * 2**40 + 2**41 for _ in range(3)], 0) for i in range(40)]
    frame = spark.createDataFrame([(i, v) for i, v, _ in rows], "vec_id long, embedding array<double>")
    deviation, _, explained = plain_whitening([[math.floor(1024 * c) + 100000 for c in v] for _, v, _ in rows])
    found = whiten.components(frame).orderBy("vec_id", "component").toPandas()
    assert [int(x) for x in found.deviation[::3]] == deviation and np.allclose(found.explained[:3], explained, rtol=1e-12)


def test_scatter_is_exact_beyond_long(spark):
    x = np.array([[2**45, -(2**44), 7], [-(2**45), 2**43 + 1, -5], [3, 2**45 - 1, 2**44]] * 9, dtype=np.int64)
    frame = spark.createDataFrame([([float((c - whiten.LIFT) / whiten.SCALE) for c in r],) for r in x.tolist()], "v array<double>").repartition(5)
    exact = x.astype(object).T @ x.astype(object)
    assert (whiten.scatter(frame, 3, np.zeros(3, np.int64), 27 * 2**90 + 1) == exact).all()


def test_whitening_without_variance_or_rows(spark):
    assert whiten.components(vectors(spark, [])).count() == 0
    assert whiten.components(vectors(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    one = whiten.components(vectors(spark, [(1, [0.5] * 4, 1)] * 2)).toPandas()
    assert len(one) == 8 and one.whitened.isna().all() and one.explained.isna().all() and set(one.deviation) == {0}
    flat = whiten.components(vectors(spark, [(i, [i / 16, 0.5, i / 8, 1.0], 1) for i in range(30)])).toPandas()
    assert flat[flat.component == 1].whitened.notna().all() and flat[flat.component > 1].whitened.isna().all() and flat.identity_error.max() < 1e-9


def library_pieces(texts, capacity):
    from tokenizers import Tokenizer

    library, out = Tokenizer.from_file(default_vocabulary()), []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = list(range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity))
        for k, (a, b) in enumerate(zip([0, *cuts], cuts)):
            out.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


def laid(found, capacity):
    """Whether each sequence's pieces fill it from 0 without a gap."""
    for _, part in found.sort_values("offset").groupby("sequence_id"):
        assert list(part.offset) == [0, *part.length.cumsum()][:-1] and part.length.sum() <= capacity


def test_packing_of_texts(spark):
    own = random.Random(2)
    texts = [None, "", " \n", "<|endoftext|> ü", *(" ".join(own.choice(["in", "antidisestablish", "é½", "the"]) for _ in range(own.randint(1, 90))) for _ in range(200)), "long " * 3000, "a" * 5000, " " * 1_200_000 + "x", "a  b \n c\x85\x1c  "]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, piece int, length int").repartition(7)
    found = packing.packed(packing.pieces(docs, 64), 64).toPandas()
    want = library_pieces(texts, 64)
    assert sorted(found[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    laid(found, 64)
    assert found.sequence_id.nunique() <= math.ceil(sum(w[3] for w in want) / 64) + 2


def test_packing_of_repeated_and_unnamed_rows(spark):
    docs = spark.createDataFrame([(1, "one two")] * 3 + [(None, "one"), (None, None)], "doc_id long, text string")
    found = packing.packed(packing.pieces(docs)).toPandas()
    laid(found, 2048)
    assert len(found) == 5 and found.sequence_id.nunique() == 1
    assert packing.packed(packing.pieces(docs.limit(0))).count() == 0


def one_by_one(lengths, limits, rule, weights):
    """Each piece by itself to the open sequence that the rule selects."""
    bins = []
    for n in sorted(lengths, reverse=True):
        item = (n, 1, n * n)
        best = None
        for b in bins:
            if all(u + i <= c for u, i, c in zip(b, item, limits)):
                if rule == "dot":
                    s = -sum(w * i / c * (c - u) / c for w, i, u, c in zip(weights, item, b, limits))
                else:
                    s = sum(w * ((c - u - i) / c) ** 2 for w, i, u, c in zip(weights, item, b, limits))
                if best is None or (s, b) < best:
                    best = (s, b)
        if best is None:
            bins.append(list(item))
        else:
            best[1][:] = [u + i for u, i in zip(best[1], item)]
    return len(bins)


@pytest.mark.parametrize("limits", [(64, 64, 4096), (64, 5, 4096), (64, 64, 4096 // 2 + 2048), (64, 7, 4500)])
def test_plan_against_one_by_one(limits):
    for seed in range(12):
        own = random.Random(seed)
        lengths = [min(64, max(1, int(own.expovariate(1 / own.choice([4, 20, 40]))))) for _ in range(own.randint(1, 400))]
        for rule, weights in packing.RULES:
            made, steps = packing.plan(dict(Counter(lengths)), *limits, rule, weights)
            assert made == one_by_one(lengths, limits, rule, weights)
            use = Counter()
            docs, cost = Counter(), Counter()
            for length, own_steps in steps.items():
                ends = [s[0] for s in own_steps[1:]] + [Counter(lengths)[length]]
                for (rank, first, take, offset), end in zip(own_steps, ends):
                    for r in range(rank, end):
                        b = first + (r - rank) // take
                        assert offset + (r - rank) % take * length == use[b]
                        use[b] += length
                        docs[b] += 1
                        cost[b] += length * length
            assert len(use) == made and max(use.values()) <= limits[0] and max(docs.values()) <= limits[1] and max(cost.values()) <= limits[2]


def test_plan_does_not_grow_with_the_rows():
    own = random.Random(1)
    shape = {n: own.randint(1, 50) for n in range(1, 2049)}
    sizes = [sum(map(len, packing.plan({n: m * k for n, m in shape.items()}, 2048, 2048, 2048**2)[1].values())) for k in (10, 10_000_000)]
    assert max(sizes) < 64 * 2 * 2048


def test_ranks_are_exact_over_buckets(spark):
    rows = spark.range(3000).selectExpr("id doc_id", "0 piece", "0L start", "if(id % 3 = 0, 7L, id % 50) length", "id % 11 ids_crc32")
    found = packing.ranked(rows, 200).toPandas()
    for _, part in found.groupby("length"):
        assert sorted(part["rank"]) == list(range(len(part)))


def plain_negatives(rows, anchor):
    rows = [(k, i, c, [math.floor(256 * x) for x in as_float(v)]) for k, (i, v, c) in enumerate(usable(rows)) if i is not None and c is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a[3], b[3]))
    out = []
    for a in (r for r in rows if anchor(r[1])):
        near = sorted((-dot(a, b), b[1], b[0]) for b in rows if b[0] != a[0] and b[2] == a[2])[:5]
        for s, name, _ in near:
            bad = sorted((-dot(a, b), b[1]) for b in rows if b[2] != a[2] and 30 * -s <= 100 * dot(a, b) <= 90 * -s)[:10]
            out += [(a[1], name, k, i, -s, -m) for k, (m, i) in enumerate(bad, 1)]
    return sorted(out)


@pytest.mark.parametrize("chunk, block", [(1 << 20, 4096), (40 * 24, 7)])
def test_negatives_against_all_pairs(spark, chunk, block):
    rows = odd_vectors()
    rows += [(600 + i, [0.25, -0.25, 0.5, 0.0, 0.0, 0.0], i % 2) for i in range(12)]  # ties
    found = negatives.mined(vectors(spark, rows).repartition(3), F.col("id") % 20 == 0, chunk=chunk, block=block).toPandas()
    want = plain_negatives(rows, lambda i: i % 20 == 0)
    assert sorted(found.itertuples(index=False, name=None)) == want


def test_negatives_without_partners(spark):
    assert negatives.mined(vectors(spark, []), F.col("id") % 2 == 0).count() == 0
    assert negatives.mined(vectors(spark, [(1, [1.0], 1)]), F.col("id") % 2 == 0).count() == 0
    assert negatives.mined(vectors(spark, [(2, [1.0, 2.0], 1), (3, [1.0, 1.0], 2)]), F.col("id") % 2 == 0).count() == 0
    assert negatives.mined(vectors(spark, [(i, [0.0, 0.0], 1) for i in range(4)] + [(9, [0.0, 0.0], 2)]), F.col("id") % 2 == 0).count() == 2 * 3


def test_bounds_hold_and_leave_few(spark):
    table = pd.read_parquet(f"{SF}/embeddings.parquet")
    rows = negatives.integers(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", "embedding", F.col("label"))
    books = negatives.centroids(rows)
    part = negatives.Chunk(negatives.encoded(rows, books).toArrow(), books)
    few = []
    for x in part.x[:40]:
        lower, upper = part.bounds(x)
        exact = part.scores(np.arange(len(part.row)), x)
        assert (lower <= exact).all() and (exact <= upper).all()
        few.append((upper >= negatives.guaranteed(lower, 10)).mean())
    assert len(part.row) == len(table) and np.mean(few) < 0.35
