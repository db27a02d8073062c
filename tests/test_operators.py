import pytest
import json

from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.operators import evaluate as E
from scholia.operators import speech as S
from scholia.operators import tree
from scholia.plans.relations import nodes, turns
from scholia.sources import blocks as B
from scholia.sources import documents
from scholia.sources import slides as S_
from scholia.streaming import state

SF = "/root/testdata/sf0.001"


def values(spark, column, *rows, schema="s string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_levels(spark):
    numbers = [(1,), (4,), (9,), (26,), (27,), (702,), (703,)]
    assert values(spark, T.roman(F.col("n")), *numbers[:3], schema="n int") == ["I", "IV", "IX"]
    assert values(spark, T.alphabetic(F.col("n")), *numbers[3:], schema="n int") == ["z", "aa", "zz", "aaa"]


def test_cuts_at_the_limit(spark):
    assert values(spark, T.truncate_ellipsis(F.col("s"), 3), ("ab",), ("abc",), ("abcd",)) == ["ab", "abc", "ab…"]
    assert values(spark, T.normalize_text(F.col("s")), ("  Perché,  NO! ",)) == ["perche no"]
    assert values(spark, T.strip_fences(F.col("s")), ("```json\n[1]\n```",), (" [2] ",)) == ["[1]", "[2]"]


def test_lookahead_in_corrections(spark):
    assert values(spark, S.corrections(F.col("s"), "en"), ("I mean .",), ("i mean, this",)) == [0, 1]
    assert values(spark, S.corrections(F.col("s"), "it"), ("scusa, intendo dire",)) == [2]


def test_batches_at_the_borders(spark):
    for n, most in ((80, 1), (81, 2), (155, 2), (156, 3)):
        rows = spark.range(n).select(F.lit(1).alias("d"), F.col("id").alias("o"))
        assert B.overlapping_batches(rows, "d", "o").agg(F.countDistinct("batch")).first()[0] == most
    for n, chunks in ((12, 1), (13, 13), (23, 23), (24, 12), (25, 13)):
        rows = spark.range(n).select(F.lit(1).alias("d"), F.col("id").alias("o"))
        assert B.fallback_chunks(rows, "d", "o", 12).agg(F.countDistinct("chunk")).first()[0] == chunks


def test_flattening_keeps_leaves(spark):
    rows = nodes(spark, SF)
    leaves = rows.where("kind = 'paragraph'").select("node_id")
    assert tree.flattened(rows, 2).join(leaves, "node_id").count() == leaves.count()


def test_nested_json_round_trip(spark, tmp_path):
    rows = nodes(spark, SF).where("kind <> 'paragraph'")
    out = documents.nested(rows, 2).withColumns({"source": F.struct(F.lit("md").alias("type"), F.lit("a.md").alias("filename"), F.lit("en").alias("language")), "metadata": F.struct(F.lit("now").alias("generated_at"))})
    documents.write_indexes(out, str(tmp_path / "x"))
    count = lambda n: 1 + sum(count(c) for c in n["children"])
    assert sum(count(json.loads(r.tree)) for r in out.collect()) == rows.count()
    (tmp_path / "y").mkdir()
    (tmp_path / "y/a.json").write_text(json.dumps({"doc_id": "1", "source": {"type": "md"}, "tree": "{}"}))
    (tmp_path / "y/b.json").write_text("no json")
    good, bad = documents.read_indexes(spark, str(tmp_path / "y"))
    assert (good.count(), bad.count()) == (1, 1)


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = turns(spark, SF).drop("event_type", "value")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = state.attempts_stream(stream).writeStream.format("memory").queryName("attempts_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.id, r.attempt, r.second) for r in E.attempts(rows).select("id", "attempt", "second").collect()}
    assert {(r.id, r.attempt, r.second) for r in spark.table("attempts_out").collect()} == want


def deck(*slides):
    """A small deck: each slide is (title, [(text, bulleted)])."""
    import io
    import zipfile

    a, p, r = (f'xmlns:{k}="{v[1:-1]}"' for k, v in (("a", S_.A), ("p", S_.P), ("r", S_.R)))
    paragraph = lambda t, b: f'<a:p><a:pPr lvl="1">{"<a:buChar/>" if b else ""}</a:pPr><a:r><a:t>{t}</a:t></a:r></a:p>'
    shape = lambda mark, body: f"<p:sp><p:nvSpPr><p:nvPr>{mark}</p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/presentation.xml", f"<p:presentation {p} {r}>" + "".join(f'<p:sldId r:id="r{i}"/>' for i in range(len(slides))) + "</p:presentation>")
        z.writestr("ppt/_rels/presentation.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="slides/s{i}.xml"/>' for i in range(len(slides))) + "</Relationships>")
        for i, (title, body) in enumerate(slides):
            shapes = shape("", "".join(paragraph(*x) for x in body)) + shape('<p:ph type="title"/>', paragraph(title, False))
            z.writestr(f"ppt/slides/s{i}.xml", f"<p:sld {a} {p}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>")
    return out.getvalue()


def test_decks(spark, tmp_path):
    (tmp_path / "a.pptx").write_bytes(deck(("One", [("x", True), (" ", True)]), ("", [("y", False)])))
    (tmp_path / "b.pptx").write_bytes(deck((" ", [])))
    (tmp_path / "c.pptx").write_bytes(b"no deck")
    got = sorted(S_.read_decks(spark, str(tmp_path)).drop("path").collect(), key=str)
    blocks = [tuple(r)[:5] for r in got if r.error is None]
    assert sorted(blocks) == [(0, 1, "slide_title", 0, "One"), (1, 1, "bullet", 1, "x"), (2, 2, "body", 1, "y")]
    assert sorted(r.error for r in got if r.error) == ["broken deck: BadZipFile", "no text"]


def test_word_at_borders(spark):
    rows = spark.createDataFrame([("ab cd", 0), ("ab cd", 2), ("ab  cd", 3), ("ab\n", 3), (None, 1), ("", 0)], "s string, n int")
    assert [r[0] for r in rows.select(T.word_at(F.col("s"), F.col("n"))).collect()] == ["ab", "ab", None, None, None, None]


def test_trace_sink(spark, tmp_path):
    rows = turns(spark, SF).select("session", "id", "ts")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).where("session < 20")
    for _ in range(2):
        state.trace_sink(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == rows.where("session < 20").count()


def test_unaccented_against_unicode(spark):
    import unicodedata

    from scholia.functions.text import KEPT, normalize_text, unaccented

    texts = ["".join(chr(c) for c in range(k, k + 64) if not any(lo <= c <= hi for lo, hi in KEPT)) for k in range(0x80, 0xFFC0, 64)] + ["e\u0301\ufb01\u00bd", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", unaccented(F.col("t")).alias("u"), normalize_text(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r.u == "".join(x for x in unicodedata.normalize("NFKD", texts[r.i]) if not unicodedata.combining(x))
    assert {r.i: r.n for r in rows}[len(texts) - 2] == "efi1 2"


def test_markdown_blocks(spark):
    from scholia.sources.markdown import markdown_blocks

    text = "intro\nover two lines\n\n# One\n\n### Deep ###\n- item\n  goes on\n\n  its own paragraph\n1. first\n```\n# no heading\n```\n\nUnder\nlined\n===\n\n    code\n\n> said\n> more\n\n---\nlast"
    rows = markdown_blocks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("ord").collect()
    assert [(r.kind, r.level, r.text) for r in rows] == [("paragraph", 0, "intro\nover two lines"), ("heading", 1, "One"), ("heading", 3, "Deep"), ("list_item", 0, "item\ngoes on"), ("list_item", 0, "its own paragraph"), ("list_item", 0, "first"), ("heading", 1, "Under\nlined"), ("paragraph", 0, "said\nmore"), ("paragraph", 0, "last")]
    assert [r.list_kind for r in rows[3:6]] == ["bullet", "bullet", "ordered"]
    assert text[rows[0].lo : rows[0].hi] == "intro\nover two lines" and text[rows[6].lo : rows[6].hi] == "Under\nlined\n==="


@pytest.mark.parametrize(
    "text, want",
    [
        ("- a\n  - b\n- c", [("list_item", "a"), ("list_item", "b"), ("paragraph", "c")]),
        ("```\n~~~\n# no\n```\nafter", [("paragraph", "after")]),
        ("````\n```\n# no\n````\n# yes", [("heading", "yes")]),
        ("a\n2. b\nc", [("paragraph", "a\n2. b\nc")]),
        ("a\n1. b", [("paragraph", "a"), ("list_item", "b")]),
        ("2. x\n3. y\n\n4) z", [("list_item", "x"), ("list_item", "y"), ("list_item", "z")]),
        ("> - x\n> - y\nlazy\n\nz", [("list_item", "x"), ("list_item", "y\nlazy"), ("paragraph", "z")]),
        ("> a\n---\n> ```\n# out", [("paragraph", "a"), ("heading", "out")]),
        ("- ```\n  in\nout", [("paragraph", "out")]),
        ("-\n  a\n-\n\n  b", [("list_item", "a"), ("paragraph", "b")]),
        ("- \tx\n\n      y", [("list_item", "x"), ("list_item", "y")]),
        ("[x]: /u 'ti'\n[y]: <z>\ntext\n\n[a]: /b", [("paragraph", "text")]),
        ("<div>\n# no\n\n# yes ##\n<!-- a\n\n# no\n-->\nb", [("heading", "yes"), ("paragraph", "b")]),
        ("* * *\n- - a\n  b\n+ c", [("list_item", "a\nb"), ("list_item", "c")]),
        ("a\n===\n\n    code\nb\n    c\n---", [("heading", "a"), ("heading", "b\n    c")]),
        ("#\n#x\n# y \\#\r", [("heading", ""), ("paragraph", "#x"), ("heading", "y \\#")]),
    ],
)
def test_markdown_containers(text, want):
    from scholia.sources.markdown import Scanner

    assert [(b[0], b[3]) for b in Scanner().scan(text)] == want


def test_aggregate_of_odd_responses(spark):
    from scholia.operators import aggregate

    refs = spark.createDataFrame([(r, f"d::{k}", k, "a.b.json", f" s{k} ") for r in range(6) for k in range(3)], "req_id int, ref_id string, ord int, source_filename string, label string")
    said = [None, "[1]", '{"tree":{"a":1}}', '{"tree":[{"label":"x","children":[{"ref_id":"d::1"},{"ref_id":"d::1"}]},{"ref_id":""},"s"]}', '{"tree":[{"ref_id":"d::9"}],"organizing_principle":4}', '{"tree":[{"ref_id":"d::2"},{"children":[{"children":[{"ref_id":"d::0"}]}]},{"label":null,"ref_id":"d::1"}]}']
    responses = spark.createDataFrame(list(enumerate(said)), "req_id int, response string")
    rows = aggregate.trees(responses, refs).collect()
    for r in range(6):
        own = [x for x in rows if x.req_id == r]
        assert sorted(x.ref_id for x in own if x.ref_id) == ["d::0", "d::1", "d::2"]
        ids = {x.node_id: x for x in own}
        assert len(ids) == len(own) and all(x.parent_id is None or ids[x.parent_id].level == x.level - 1 for x in own)
    at = lambda r: sorted((x.node_id, x.label) for x in rows if x.req_id == r and x.kind != "root")
    assert at(0) == at(1) == at(2) == [("agg_1", "a.b"), ("agg_1_1", "s0"), ("agg_1_2", "s1"), ("agg_1_3", "s2")]
    assert at(3) == [("agg_1", "x"), ("agg_1_1", "s1"), ("root_2", "Senza categoria"), ("root_2_1", "s0"), ("root_2_2", "s2")]
    assert at(4) == [("root_1", "Senza categoria"), ("root_1_1", "s0"), ("root_1_2", "s1"), ("root_1_3", "s2")]
    assert at(5) == [("agg_1", "s2"), ("agg_2", "Categoria 2"), ("agg_2_1", "Categoria 1"), ("agg_2_1_1", "s0"), ("agg_3", "s1")]
    heads = {r.req_id: (r.principle, len(r.warnings), r.n_dropped) for r in aggregate.headers(responses, refs).collect()}
    assert heads == {0: ("structural", 1, 0), 1: ("structural", 1, 0), 2: ("structural", 1, 0), 3: ("topical", 1, 2), 4: ("topical", 2, 3), 5: ("topical", 0, 0)}


def test_two_passes_boundaries(spark):
    from scholia.operators.tree import two_passes

    sizes = {1: 1, 12: 12, 13: 13, 25: 25, 9: 9, 8: 8}
    items = spark.createDataFrame([(d, f"i{k}", k) for d, n in sizes.items() for k in range(n)], "doc_id int, item_id string, ord long")
    ranges = spark.createDataFrame([], "doc_id int, pos long, start_id string, end_id string")
    failed = spark.createDataFrame([(d,) for d in (12, 13, 25)], "doc_id int")
    rows = two_passes(items, ranges, failed, ranges, spark.createDataFrame([(9,)], "doc_id int")).collect()
    sections = {d: len({r.section for r in rows if r.doc_id == d}) for d in sizes}
    assert sections == {1: 1, 12: 1, 13: 13, 25: 13, 9: 9, 8: 8}
    assert {r.level for r in rows if r.doc_id == 8} == {2} and {r.level for r in rows if r.doc_id == 9} == {3}
    assert len({r.chapter for r in rows if r.doc_id == 9}) == 9


def test_evaluated_turns(spark):
    from scholia.operators import evaluate

    rows = [(1, "n", 1, 1, "mcq", "b", None), (1, "n", 2, 2, "flashcard", " CAFÉ! ", None), (1, "n", 3, 3, "open", "", "alta"), (1, "n", 4, 4, "open", "", None), (1, "n", 5, 5, "mcq", "A", None), (1, "m", 1, 6, "essay", "", None)]
    turns = spark.createDataFrame(rows, "session int, node string, ts int, id int, kind string, response string, c string")
    turns = turns.withColumn("options", F.array(F.lit("x"), F.lit("y"))).withColumn("correct", F.lit(0)).withColumn("expected", F.lit("cafe")).withColumn("fuzzy", F.lit(None).cast("double")).withColumn("k", F.lit("errata")).withColumn("e", F.lit("riportata"))
    got = {r.id: (r.correct, r.error, r.attempt, r.intervention, r.status) for r in evaluate.evaluated(turns).collect()}
    assert got == {1: (False, None, 1, "hint_plus_redirect", "pending"), 2: (True, None, 2, "advance", "passed"), 3: (None, None, 2, "full_redirect", "fragile"), 4: (None, "no valid judgment", None, None, None), 5: (True, None, 3, "advance", "passed"), 6: (None, "unknown assessment type", None, None, None)}


def test_space_before_a_line_separator_stays(spark):
    """As in SQL, the end is that of the whole text; words of four letters and more are found whole."""
    import duckdb

    rows = [(0, "a \u2028"), (1, " \t abcd xyz é\u0301lève_1 \n"), (2, ""), (3, None), (4, "\ufb01n\u2026 caf\u00e9 \u20ac ok")]
    c = F.col("text")
    found = spark.createDataFrame(rows, "id long, text string").select("id", T.stripped(c).alias("s"), T.normalize_token(c).alias("t"), F.array_sort(T.content_words(c)).alias("w"), T.normalize_text(c).alias("n"))
    got = {r.id: r for r in found.collect()}
    for i, t in rows:
        (want,) = duckdb.execute(r"SELECT regexp_replace(?::VARCHAR, '^\s+|\s+$', '', 'g')", [t]).fetchone()
        assert got[i].s == want
    assert got[0].t == "a " and sorted(got[1].w) == ["abcd", "lève_1"] and got[3].w is None
    assert got[4].n == "fin cafe ok"
