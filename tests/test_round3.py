"""Ancestors, streams from saved state, cleaning, requests, annotations, decks."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholia.operators import ancestry, cleaning, language, ledger, store, tree
from scholia.session import scratch
from scholia.sources import decks, markdown
from scholia.streaming import state


def test_paths_with_faults(spark):
    chain = [("d", f"c{i}", f"c{i - 1}" if i else None) for i in range(40)]
    rows = [*chain, ("d", "o", "gone"), ("d", "p", "o"), ("d", "x", "y"), ("d", "y", "x"), ("d", "z", "x"), ("d", "s", "s"), ("e", "c0", "c1"), ("e", "c1", None), ("d", "p", "z"), ("d", None, "c0")]
    found = {(r.doc_id, r.node_id): (r.path, r.fault) for r in ancestry.paths(spark.createDataFrame(rows, "doc_id string, node_id string, parent_id string")).collect()}
    assert len(found) == 48 and found["d", "c39"] == ([f"c{i}" for i in range(40)], None)
    assert found["d", "o"] == (["o"], "orphan") and found["d", "p"] == (["o", "p"], "orphan") and found["e", "c0"] == (["c1", "c0"], None)
    assert {k[1] for k, v in found.items() if v[1] == "cycle"} == {"x", "y", "z", "s"}
    assert ancestry.paths(spark.createDataFrame([], "doc_id string, node_id string, parent_id string")).count() == 0


def test_paths_over_pieces(spark, monkeypatch):
    chain = [("d", f"c{i}", f"c{i - 1}" if i else None) for i in range(70)]
    ring = [("d", f"r{i}", f"r{(i + 1) % 33}") for i in range(33)]
    rows = [*chain, *ring, ("d", "t", "r7"), ("d", "o0", "gone"), *[("d", f"o{i}", f"o{i - 1}") for i in range(1, 12)], ("d", "c9", "z"), (None, "n", "c1"), (None, "m", "n"), ("e", "o5", "c5")]
    dealt = spark.createDataFrame(rows, "doc_id string, node_id string, parent_id string").repartition(7, "node_id")
    for piece in (3, 1 << 16):
        monkeypatch.setattr(ancestry, "PIECE", piece)
        found = {(r.doc_id, r.node_id): (r.path, r.fault) for r in ancestry.paths(dealt).collect()}
        want = {("d", f"c{i}"): ([f"c{j}" for j in range(i + 1)], None) for i in range(70)} | {("d", n): (None, "cycle") for _, n, _ in [*ring, ("d", "t", "")]}
        want |= {("d", f"o{i}"): ([f"o{j}" for j in range(i + 1)], "orphan") for i in range(12)} | {(None, "n"): (["n"], "orphan"), (None, "m"): (["m"], "orphan"), ("e", "o5"): (["o5"], "orphan")}
        assert found == want


def test_paths_move_once_at_most(spark):
    """Neither rings nor finished lines are carried through the rounds."""
    rings = spark.range(2000).selectExpr("'d' doc_id", "concat('n', id) node_id", "concat('n', id - id % 3 + (id + 1) % 3) parent_id")
    lines = spark.range(2000).selectExpr("'d' doc_id", "concat('c', id) node_id", "if(id % 20 = 0, null, concat('c', id - 1)) parent_id")
    steps = []
    kept = ancestry.stored
    ancestry.stored = lambda df, label, *codec: steps.append((label, kept(df, label, *codec))) or steps[-1][1]
    try:
        assert ancestry.paths(rings.unionByName(lines)).count() == 4000
    finally:
        ancestry.stored = kept
    assert sum(df.count() for label, df in steps if label != "paths-near") < 400


def test_lowest_common_of_odd_pairs(spark):
    found = spark.createDataFrame([("d", n, p) for n, p in [("a", ["r", "a"]), ("b", ["r", "a", "b"]), ("c", ["r", "c"]), ("q", ["q"])]], "doc_id string, node_id string, path array<string>")
    pairs = spark.createDataFrame([("d", "b", "c"), ("d", "b", "a"), ("d", "b", "b"), ("d", "b", "q"), ("d", "b", "none")], "doc_id string, a string, b string")
    assert {(r.a, r.b): (r.ancestor, r.steps) for r in ancestry.lowest_common(pairs, found).collect()} == {("b", "c"): ("r", 3), ("b", "a"): ("a", 1), ("b", "b"): ("b", 0), ("b", "q"): (None, None), ("b", "none"): (None, None)}


def test_stream_resumes_orders_and_forgets(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    ok, no = ("alta", "corretta", "rielaborata"), ("assente", "errata", "riportata")
    kind = "session long, node long, ts timestamp, id long, c string, k string, e string"
    files = [[(1, 0, at(3), 3, *no), (1, 0, at(1), 1, *no), (2, 0, at(2), 2, *ok)], [(1, 0, at(2), 4, *ok), (1, 0, at(5), 5, *no)], [(1, 0, at(80), 6, *no)], [(9, 9, at(500), 9, *ok)]]
    path = scratch(spark, "stream")
    for rows in files:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    saved = spark.createDataFrame([('{"session": 1, "nodes": [{"node": 0, "failed": 2}]}',), ('{"session": 2, "nodes": [{"no',), ("",), (None,)], "value string")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    found = state.drained(state.resumed_attempts(stream, state.read_sessions(saved), "2 hours", idle_days=2), scratch(spark, "out"), scratch(spark, "checkpoint"))
    got = {r.id: (r.attempt, r.second, r.failed_attempts) for r in found.collect()}
    # session 1 begins with two failures, and is forgotten before its last turn; session 2's state can't be read
    assert got == {1: (3, True, 3), 4: (4, True, 3), 3: (4, True, 4), 5: (5, True, 5), 6: (1, False, 1), 2: (1, False, 0)}


def test_collapsing_takes_few_paths_apart(spark):
    kind = "doc_id string, node_id string, parent_id string, kind string, label string, text string, path array<string>"
    a = [("a", "r", None, "root", None, None, ["r"]), ("a", "c", "r", "chapter", "c", None, ["r", "c"]), ("a", "s", "c", "section", "s", None, ["r", "c", "s"]), ("a", "p", "s", "paragraph", None, "x", ["r", "c", "s", "p"])]
    b = [("b", "r", None, "root", None, None, ["r"]), ("b", "c", "r", "chapter", "c", None, ["r", "c"]), ("b", "p", "c", "paragraph", None, "x", ["r", "c", "p"])]
    found = {(r.doc_id, r.node_id): (r.parent_id, r.level) for r in tree.collapsed(spark.createDataFrame(a + b, kind)).collect()}
    assert found == {("a", "r"): (None, 0), ("a", "s"): ("r", 1), ("a", "p"): ("s", 2), ("b", "r"): (None, 0), ("b", "c"): ("r", 1), ("b", "p"): ("c", 2)}
    plain = tree.shortened(spark.createDataFrame(b, kind))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plain and "Exchange" not in plain


def test_cleaning_shuffles_nothing(spark):
    rows = spark.createDataFrame([(1, "a, a b"), (1, "Ab-Abc  ehm, è-È è-èra"), (None, "um")], "k int, text string")
    found = cleaning.cleaned(rows, ["k"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Window", "Join"))
    assert [(r.k, r.text, r.starts) for r in found.collect()] == [(1, "a b", [3, 5]), (1, "Abc È èra", [3, 15, 19]), (None, "", [])]


def test_markdown_of_many_texts_is_told_in_pieces(spark):
    docs = spark.range(300).selectExpr("id doc_id", "if(id % 50 = 49, null, repeat(concat('- ', id, ' word\\n'), 2000)) text").coalesce(1)
    sizes = markdown.markdown_blocks(docs).mapInArrow(lambda parts: (pa.RecordBatch.from_pydict({"n": [p.num_rows]}) for p in parts), "n long").collect()
    assert sum(r.n for r in sizes) == 294 * 2000
    sent = []
    frame = type("", (), {"schema": docs.schema, "select": lambda self, *c: self, "mapInArrow": lambda self, run, kind: run})()
    texts = ["- a\n" * 100_000] * 6
    for part in markdown.markdown_blocks(frame)(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "text": texts})])):
        sent.append(part.num_rows)
    assert len(sent) == 2 and sum(sent) == 600_000


def test_nodes_of_a_session_share_a_key(spark):
    kind = "session long, node long, ts timestamp, id long, c string, k string, e string"
    path, no = scratch(spark, "nodes-stream"), ("assente", "errata", "riportata")
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    for rows in ([(1, 0, at(1), 1, *no), (1, 1, at(2), 2, *no), (1, 0, at(2), 3, *no)], [(1, 1, at(60), 4, *no)], [(9, 9, at(500), 9, *no)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    saved = spark.createDataFrame([(1, 0, 2), (1, 5, 7)], "session long, node long, failed long")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    found = state.resumed_attempts(stream, saved, "2 hours", idle_days=2)
    got = {(r.node, r.id): r.failed_attempts for r in state.drained(found, scratch(spark, "nodes-out"), scratch(spark, "nodes-checkpoint")).collect()}
    # each node has its own count, and is forgotten by itself: node 1's second turn comes after two days
    assert got == {(0, 1): 3, (0, 3): 4, (1, 2): 1, (1, 4): 1}


def test_a_session_is_one_file_of_traces(spark):
    path, feed = scratch(spark, "traces-test"), scratch(spark, "feed-test")
    events = spark.range(400).selectExpr("id % 5 session", "id", "'a' at", "'b' c", "'b' k", "'b' e").repartition(8, "id")
    events.write.parquet(feed)
    state.trace_sink(spark.readStream.schema(events.schema).parquet(feed), path, scratch(spark, "traces-test-checkpoint")).awaitTermination()
    read = spark.read.schema("id long, session long").json(path)
    assert read.select(F.input_file_name()).distinct().count() == 5 and read.distinct().count() == 400


@pytest.mark.parametrize(
    "said, want",
    [
        ("ehm, allora, la la catena di Markov è è un processo stocastico che, ehm, non ha memoria", "allora, la catena di Markov è un processo stocastico che, non ha memoria"),
        ("la, la teoria di M-Markov, very, very important", "la teoria di Markov, very, very important"),
        ("the the the model. Model uh, um", "the model. Model"),
        ("the entropy is, ehm, the expected value", "the entropy is, the expected value"),
        ("Uhm ehm", ""),
        (None, ""),
    ],
)
def test_cleaning_by_rule(spark, said, want):
    row = cleaning.cleaned(spark.createDataFrame([(1, said)], "id int, text string"), ["id"]).first()
    assert row.text == want and len(row.starts) == len(want.split())
    for start, word in zip(row.starts, want.split()):
        assert said[start:].startswith(word)


def test_cleanings_that_are_none(spark):
    source = spark.createDataFrame([(1, 0, "a", "ehm, la la catena di Markov è un processo stocastico"), (1, 1, "b", "lo stato successivo dipende solo dallo stato attuale"), (2, 0, "a", "Allora codri contro il tempo che il denaro non ti aspetta"), (2, 1, "b", "Fini di nostra madre, vogliamo solo amare"), (3, 0, "a", "Allora codri contro il tempo che il denaro non ti aspetta"), (3, 1, "b", "Fini di nostra madre, vogliamo solo amare"), (4, 0, "a", "Allora corri contro il tempo che il denaro non ti aspetta")], "req_id int, ord int, id string, text string")
    answers = [(1, 0, "a", "A Markov chain is a memoryless stochastic process."), (2, 0, "a", "Allora corri contro il tempo che il denaro non ti aspetta."), (2, 1, "b", "Figli di nostra madre, vogliamo solo amare."), (2, 2, "c", "x"), (3, 1, "a", "Allora corri"), (3, 0, "b", "Fini di nostra madre, vogliamo solo amare"), (4, 0, "a", "Allora corri contro il tempo che la moneta non ti aspetta")]
    found = {(r.req_id, r.id): (r.fault, r.text) for r in cleaning.accepted(source, spark.createDataFrame(answers, "req_id int, pos int, id string, text string")).collect()}
    assert {k: v[0] for k, v in found.items()} == {(1, "a"): "rewritten", (1, "b"): "missing", (2, "a"): None, (2, "b"): None, (3, "a"): "shortened", (3, "b"): "moved", (4, "a"): "swapped"}
    assert found[2, "b"][1] == "Figli di nostra madre, vogliamo solo amare." and found[1, "b"][1].startswith("lo stato")


def test_language_of_unseen_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200")
    model = language.profiles(docs.where("doc_id % 5 <> 0"))
    held = docs.where("doc_id % 5 = 0")
    found = language.detected(held, model, "text").join(held.select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.count_if(F.col("language") == F.col("lang")), F.count("*")).first()
    assert n > 100 and right >= 0.97 * n
    odd = language.detected(spark.createDataFrame([(1, None), (2, ""), (3, "123 !?")], "doc_id int, sample string"), model).collect()
    assert [r.language for r in odd] == [None] * 3


def test_pairs_are_counted_where_texts_are_read(spark):
    texts = spark.createDataFrame([("it", "Là, là!"), ("it", "x" * 5000), ("en", None), ("en", "K2 Ab")], "lang string, text string")
    found = {(r.language, r.pair): r.n for r in language.pairs(texts.withColumnRenamed("lang", "language"), "text").collect()}
    assert found == {("it", " l"): 2, ("it", "là"): 2, ("it", "à "): 2, ("it", " x"): 1, ("it", "xx"): 4999, ("it", "x "): 1, ("en", " k"): 1, ("en", "k "): 1, ("en", " a"): 1, ("en", "ab"): 1, ("en", "b "): 1}
    docs = spark.createDataFrame([(1, "là"), (2, "ab"), (3, "")], "doc_id int, sample string").repartition(3)
    plan = language.detected(docs, language.profiles(texts))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan  # a sample's pairs stay with it


def test_ledger_states(spark):
    asked = ledger.addressed(spark.createDataFrame([("clean", "a"), ("clean", "a"), ("clean", "b"), ("clean", "c"), ("clean", "d")], "kind string, payload string"))
    at = {r.payload: r.address for r in asked.collect()}
    answers = [(at["a"], 2, "[2]"), (at["a"], 1, "[1]"), (at["b"], 1, None), (at["b"], 1, None), (at["c"], 1, "x"), (at["c"], 2, "{}"), (at["c"], 3, None), ("other", 1, "[1]")]
    book = ledger.ledger(asked, spark.createDataFrame(answers, "address string, attempt int, body string"))
    assert {r.address: (r.uses, r.tries, r.state, r.answer) for r in book.collect()} == {at["a"]: (2, 2, "answered", "[1]"), at["b"]: (1, 1, "failed", None), at["c"]: (1, 3, "rejected", None), at["d"]: (1, 0, "open", None)}
    assert {(r.address, r.attempt) for r in ledger.due(book).collect()} == {(at["b"], 2), (at["d"], 1)}


def test_annotations_keep_deletions(spark):
    kind = "material int, node string, html string, at int, seq int"
    path = scratch(spark, "annotations-test")
    store.annotate(path, spark.createDataFrame([(1, "a", "x", 1, 1), (1, "b", "y", 5, 1), (2, "a", "z", 1, 1), (3, "a", "q", 1, 1)], kind))
    found = store.annotate(path, spark.createDataFrame([(1, "a", "", 3, 1), (1, "b", "old", 4, 1), (2, "a", "new", 1, 2)], kind))
    assert {r.material: r.html for r in found.collect()} == {1: {"b": "y"}, 2: {"a": "new"}, 3: {"a": "q"}}
    found = store.annotate(path, spark.createDataFrame([(1, "a", "late", 2, 1)], kind))
    assert {r.material: r.html for r in found.collect()}[1] == {"b": "y"}


def test_deck_source(spark, tmp_path):
    decks.registered(spark)
    rows = [("a", [("T <&>", [("one", 0, True), (" ", 0, False), ("two\x0b", 1, False)]), (None, [])]), ("b", []), ("c", [(" ", [])])]
    made = spark.createDataFrame(rows, "name string, slides array<struct<title: string, body: array<struct<text: string, indent: int, bullet: boolean>>>>")
    for _ in range(2):  # written again, the files stay one each
        made.write.format("decks").mode("append").save(f"file://{tmp_path}")
    (tmp_path / "bad.pptx").write_bytes(b"no archive")
    found = spark.read.format("decks").option("bytes", 1).load(f"file://{tmp_path}").orderBy("path", "ord").collect()
    assert [(r.path[-6:-5], r.slide, r.kind, r.indent, r.text, r.error) for r in found] == [("a", 1, "slide_title", 0, "T <&>", None), ("a", 1, "bullet", 0, "one", None), ("a", 1, "body", 1, "two", None), ("b", None, None, None, None, "no text"), ("d", None, None, None, None, "broken deck: BadZipFile"), ("c", None, None, None, None, "no text")]
    assert spark.read.format("decks").schema("kind string").load(f"file://{tmp_path}").where("kind = 'bullet'").count() == 1
