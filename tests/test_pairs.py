"""Lowest common ancestors of pairs that come with their nodes: held to brute force, and few paths move."""

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import TABLES, hold  # noqa: E402

from scholia.operators import ancestry  # noqa: E402
from scholia.plans import queries_ancestry, registry  # noqa: E402
from scholia.session import stored  # noqa: E402

KIND = "doc_id string, node_id string, parent_id string, other string, paired boolean"


def brute(rows):
    parents = {}
    for doc, node, parent, *_ in rows:
        if node is not None:
            parents.setdefault((doc, node), []).append(parent)
    least = {k: min(v, key=lambda p: (p is not None, p or "")) for k, v in parents.items()}

    def path(doc, node):
        out = []
        while doc is not None and (doc, node) in least:
            if node in out:
                return []
            out.append(node)
            node = least[doc, node]
        return out[::-1]

    found = []
    for doc, a, _, b, paired in rows:
        if paired:
            x, y = path(doc, a), path(doc, b)
            n = sum(u == v for u, v in zip(x, y))
            found.append((doc, a, b, x[n - 1] if n else None, len(x) + len(y) - 2 * n if n else None))
    return sorted(found, key=str)


def odd_rows():
    chain = [("d", f"c{i}", f"c{i - 1}" if i else None, f"c{i * 7 % 90}", i % 3 == 0) for i in range(80)]
    limbs = [("d", f"l{i}", f"c{i}", f"l{(i + 40) % 80}", True) for i in range(80)]
    rings = [("d", f"r{i}", f"r{(i + 1) % 33}", f"r{i}", i % 4 == 0) for i in range(33)]
    below = [("d", f"t{i}", f"t{i - 1}" if i else "r7", f"t{i // 2}", True) for i in range(9)]
    orphans = [("d", f"o{i}", f"o{i - 1}" if i else "gone", f"o{i // 2}", True) for i in range(40)] + [("d", "p", "gone", "o3", True)]
    again = [("d", "c9", "zz", "c3", True), ("d", "c9", None, "c12", True), ("d", "c9", None, "c12", True), ("e", "s", "s", "s", True), ("e", "u", None, "u", True), ("e", "u", None, None, True), ("e", "v", "u", "c5", True), ("e", "c5", "u", "v", True)]
    nulls = [(None, "n", None, "n", True), (None, "m", "n", "n", True), ("e", None, "u", "v", True), ("e", None, None, None, True), (None, None, None, None, True), ("e", "w", "u", "v", None), ("e", "", "v", "", True)]
    return chain + limbs + rings + below + orphans + again + nulls


@pytest.mark.parametrize(("piece", "dealt"), [(7, True), (20, False), (1 << 16, False)])
def test_pairs_agree_with_brute_force(spark, monkeypatch, piece, dealt):
    monkeypatch.setattr(ancestry, "PIECE", piece)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(piece))
    rows = odd_rows()
    if dealt:
        random.Random(4).shuffle(rows)
    try:
        nodes = stored(spark.createDataFrame(rows, KIND).coalesce(3), "test-nodes")
        found = sorted(map(tuple, ancestry.lowest_common_beside(nodes).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == brute(rows)


def test_random_forests_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ancestry, "PIECE", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    pick = random.Random(1)
    rows = [(f"d{i % 2}", str(i), None if pick.random() < 0.03 else str(max(0, i - pick.randint(-1, 12))), str(max(0, i - pick.randint(-60, 60))), pick.random() < 0.5) for i in range(1200)]
    try:
        nodes = stored(spark.createDataFrame(rows, KIND).coalesce(2), "test-nodes")
        assert sorted(map(tuple, ancestry.lowest_common_beside(nodes).collect()), key=str) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pieces_may_differ_between_passes(spark, monkeypatch):
    """Lines of the second pass may end elsewhere than those of the first; what they point at then is followed too."""
    labels = []

    def noted(df, label, *codec):
        out = stored(df, label, *codec)
        labels.append(label)
        monkeypatch.setattr(ancestry, "PIECE", 13 if label == "pairs-near" else ancestry.PIECE)
        return out

    monkeypatch.setattr(ancestry, "PIECE", 30)
    monkeypatch.setattr(ancestry, "stored", noted)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        nodes = stored(spark.createDataFrame(odd_rows(), KIND).coalesce(1), "test-nodes")
        assert sorted(map(tuple, ancestry.lowest_common_beside(nodes).collect()), key=str) == brute(odd_rows())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "paths-more" in labels


def test_few_paths_are_made(spark, monkeypatch):
    """Pairs within a piece and a tree need no paths; before, those of all nodes were stored and moved."""
    steps = {}
    monkeypatch.setattr(ancestry, "stored", lambda df, label, *codec: steps.setdefault(label, stored(df, label, *codec)))
    nodes = queries_ancestry.chains(spark, "/root/testdata/sf0.001").count()
    pairs = queries_ancestry.lowest_common_ancestors(spark, "/root/testdata/sf0.001").count()
    assert steps["paths-near"].count() < 0.6 * pairs < 0.05 * nodes


@pytest.mark.parametrize("keys", [[], [None, None, 3, 3, 5, 102, 102, 15, 112, 112, 112, 2, 13, 13, 0, 97, 12, 12, 12, 12, 12, 12, 12, 12, 12, 23, 34]])
def test_odd_keys_agree_with_sql(spark, tmp_path, keys):
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    (tmp_path / "lineitem.parquet").unlink()
    pq.write_table(pa.table({"l_orderkey": pa.array(keys, pa.int64())}), tmp_path / "lineitem.parquet")
    hold(spark, registry.QUERIES["lowest_common_ancestors"], registry.ORACLE_SQL["lowest_common_ancestors"], str(tmp_path))


def test_repeated_hashes_are_found_across_packs():
    own = np.unique(np.random.default_rng(0).integers(0, 1 << 48, 5000))
    again = own[::97]
    packs = pa.Table.from_batches([b for part in np.array_split(np.concatenate([own, again, again[:9]]), 7) for b in ancestry.packed(iter([pa.RecordBatch.from_arrays([pa.array(part)], ["own"])]))])
    found = [h for cell in set(packs.column("cell").to_pylist()) for h in ancestry.twice(packs.filter(pc.equal(packs.column("cell"), cell))).column("own").to_pylist()]
    assert sorted(found) == again.tolist()
    same = pa.Table.from_batches(ancestry.packed(iter([pa.RecordBatch.from_arrays([pa.array([5, 5, 5])], ["own"])])))
    assert ancestry.twice(same).column("own").to_pylist() == [5] and len(same) == 1


def test_filter_loses_none(spark):
    ids = spark.range(20000).selectExpr("concat('d', id % 3) doc_id", "cast(id as string) node_id")
    bits = ancestry.sieve(ids.where("cast(node_id as long) % 4 = 0"))
    rows = ids.selectExpr("cast(node_id as long) % 4 = 0 wanted", "xxhash64(doc_id, node_id) own").toPandas()
    let = ancestry.passing(rows["own"].to_numpy(), bits)
    assert let[rows["wanted"]].all() and let[~rows["wanted"]].mean() < 0.01
