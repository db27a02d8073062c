"""Turns without a session or node, saved nodes told twice, breadcrumbs, traces."""

import datetime as dt
from types import SimpleNamespace

from pyspark.sql import Row

from scholia.operators import ancestry
from scholia.session import scratch, setting
from scholia.streaming import state

TURNS = "session long, node long, ts timestamp, id long, c string, k string, e string"
OK, NO = ("alta", "corretta", "rielaborata"), ("assente", "errata", "riportata")


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def resumed(spark, files, saved):
    path = scratch(spark, "turns-test")
    for rows in files:
        spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(path)
    found = state.resumed_attempts(stream, spark.createDataFrame(saved, "session long, node long, failed long").coalesce(1), "2 hours")
    return sorted(tuple(r) for r in state.drained(found, scratch(spark, "turns-out"), scratch(spark, "turns-checkpoint")).fillna(-1).collect())


def test_turns_without_session_or_node_are_numbered(spark):
    files = [[(None, 0, at(2), 1, *NO), (1, None, at(1), 2, *NO), (None, 0, at(1), 3, *NO), (1, 0, at(1), 4, *NO)], [(1, None, at(3), 5, *OK), (1, 0, at(3), 6, None, *NO[1:])], [(9, 9, at(500), 9, *OK)]]
    found = resumed(spark, files, [(1, 0, 2), (1, 0, 7), (4, 4, 1)])
    # session, node, id, attempt, second, failed_attempts; of a node saved twice the first counts
    assert found == [(-1, 0, 1, 2, True, 2), (-1, 0, 3, 1, False, 1), (1, -1, 2, 1, False, 1), (1, -1, 5, 2, True, 1), (1, 0, 4, 3, True, 3), (1, 0, 6, 4, True, 4)]


def test_many_turns_of_a_session_wait_in_parts(spark):
    n = 2 * state.APPENDED + 7
    found = resumed(spark, [[(1, i % 2, at(0) + dt.timedelta(seconds=n - i), i, *NO) for i in range(n)], [(9, 9, at(500), -9, *OK)]], [(1, 0, 5)])
    assert {r[2]: r[5] for r in found} == {i: (n - 1 - i) // 2 + 1 + 5 * (i % 2 == 0) for i in range(n)}


def test_breadcrumbs_of_odd_nodes(spark):
    kind = "doc_id string, node_id string, parent_id string, kind string, label string"
    rows = [("d", "r", None, "root", "R"), ("d", "c", "r", "chapter", " C "), ("d", "s", "c", None, "S"), ("d", "p", "s", "paragraph", "P"), ("d", "q", "s", "paragraph", None), ("d", "q", "s", "section", "b"), ("d", "q", "s", "section", "a"), ("d", "t", "q", "paragraph", "")]
    rows += [("d", "o", "gone", "section", None), ("d", "x", "y", "section", "x"), ("d", "y", "x", "section", "y"), (None, "n", None, "section", "n"), (None, "m", "n", "section", "m"), ("e", "c", None, "root", "E"), ("d", None, "c", "section", "no id")]
    nodes = spark.createDataFrame(rows, kind)
    got = {(r.doc_id, r.node_id): (r.labels, r.section) for r in ancestry.breadcrumbs(nodes, ancestry.paths(nodes)).collect()}
    # of nodes without a document nothing is known, one without a kind is passed over; the labels of a repeated id are all told
    assert got == {("d", "r"): ([], None), ("d", "c"): (["C"], "c"), ("d", "s"): (["C"], "c"), ("d", "p"): (["C", "P"], "c"), ("d", "q"): (["C", "a", "b"], "q"), ("d", "t"): (["C", "a", "b"], "q"), ("d", "o"): ([], "o"), (None, "n"): ([], None), (None, "m"): ([], None), ("e", "c"): ([], None)}


def test_siblings_share_their_parents_crumbs(spark):
    """Paths are taken apart once for each parent, not for each leaf."""
    kind = "doc_id string, node_id string, parent_id string, kind string, label string"
    inner = [("d", "r", None, "root", "R"), ("d", "c", "r", "chapter", "C"), *[("d", f"s{i}", "c", "section", f"S{i}") for i in range(10)]]
    nodes = spark.createDataFrame([*inner, *[("d", f"p{i}", f"s{i % 10}", "paragraph", None) for i in range(1000)]], kind)
    found = ancestry.breadcrumbs(nodes, ancestry.paths(nodes))
    assert {r.node_id: (r.labels, r.section) for r in found.collect()}["p7"] == (["C", "S7"], "s7")
    _, _, below = found._jdf.queryExecution().optimizedPlan().toString().partition("Generate ")
    assert "Aggregate [doc_id" in below.partition("Join ")[0]


def test_a_task_reads_many_traces(spark, monkeypatch):
    path, feed, key = scratch(spark, "totals-test"), scratch(spark, "totals-feed"), "spark.sql.files.openCostInBytes"
    spark.range(600).selectExpr("if(id < 2, null, id % 200) session", "id", "if(id % 7 = 0, null, concat('2024-', id)) at", "'b' c", "'b' k", "'b' e").coalesce(1).write.parquet(feed)
    state.trace_sink(spark.readStream.schema("session long, id long, at string, c string, k string, e string").parquet(feed), path, scratch(spark, "totals-checkpoint")).awaitTermination()
    tasks, kept, before = [], state.stored, spark.conf.get(key)
    monkeypatch.setattr(state, "stored", lambda df, label: tasks.append(spark.read.schema("id long").json(path).rdd.getNumPartitions()) or kept(df, label))
    with setting(spark, "spark.sql.files.maxPartitionBytes", "16m"):
        usual = spark.read.schema("id long").json(path).rdd.getNumPartitions()
        found = {r.session: (r.n, r.first, r.last, r["at"]) for r in state.trace_totals(spark, path).collect()}
    assert len(found) == 201 and found[None] == (2, 0, 1, "2024-1") and found[7] == (3, 7, 407, "2024-407") and found[0] == (2, 200, 400, "2024-400")
    assert spark.conf.get(key) == before and tasks[0] * 4 < usual


def test_waiting_turns_are_few_elements():
    """An element of the state is parsed with its schema, which took longer than the turn in it."""
    kept, n = [], state.APPENDED + 5
    one = state.Attempts(1)
    one.waiting, one.handle = SimpleNamespace(appendValue=kept.append), SimpleNamespace(registerTimer=kept.append)
    rows = (Row(session=1, node=i % 3, ts=state.EPOCH + i * state.MICRO if i else None, id=i, ok=None) for i in range(n))
    assert list(one.handleInputRows((1,), rows, None)) == []
    assert [len(part[1]) for part in kept[:-1]] == [state.APPENDED, 5] and kept[-1] == n // 1000 + 1
    assert [x[:2] for x in kept[0]] == [[state.FIRST, 1], [0, 1], [False, False], [0, 1]]
