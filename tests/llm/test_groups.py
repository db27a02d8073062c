"""Large groups of near copies."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from scholia.llm import common, simhash  # noqa: E402


def test_sketches_lose_no_pair():
    own = random.Random(8)
    for _ in range(400):
        base = [b"w%d" % own.randrange(10**6) for _ in range(own.choice([3, 20, 150, 900]))]
        other = [b"x%d" % own.randrange(10**6) if own.random() < 0.02 else w for w in base][: own.randint(len(base) // 2, len(base))]
        a, b = simhash.shingles(base, 5), simhash.shingles(other, 5)
        x, y = simhash.sketch(a), simhash.sketch(b)
        apart = sum((int(p) ^ int(q)) % 2**64 != 0 and ((int(p) ^ int(q)) % 2**64).bit_count() for p, q in zip(x, y))
        assert max(apart, abs(len(a) - len(b))) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_a_large_group_is_not_expanded(spark, monkeypatch):
    """Near copies of one text, many of which don't agree by 0.8: the same groups as by all pairs, few pairs verified."""
    own = random.Random(3)
    base = ["w%d" % own.randrange(10**6) for _ in range(150)]
    texts = []
    for _ in range(500):
        copy = list(base)
        for _ in range(own.randint(1, 6)):
            copy[own.randrange(150)] = "v%d" % own.randrange(10**6)
        texts.append(copy)
    sets = [{tuple(t[i : i + 5]) for i in range(146)} for t in texts]
    group = list(range(len(texts)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared >= 0.8 * (292 - shared):
                x, y = sorted((find(i), find(j)))
                group[y] = x
    rows = []
    verified = simhash.verified

    def counted(docs, classes, pairs, size, least):
        pairs = common.written(pairs, "counted")
        rows.append(pairs.count())
        return verified(docs, classes, pairs, size, least)

    monkeypatch.setattr(simhash, "verified", counted)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.lead for r in simhash.similar(docs).collect()}
    right = sum(found[i] == find(i) for i in range(len(texts)))
    assert right >= 0.97 * len(texts)
    assert sum(rows) < len(texts) * (len(texts) - 1) / 2 / 10
