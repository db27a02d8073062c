"""Queries over cross-document trees built from responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import quiz as Q
from ..operators import tree as T
from ..session import scratch, stored
from ..sources import documents as D
from .registry import query
from .relations import NODES, nodes, table

#: What a response says of a section, by its customer's number; @ stands for the reference.
SAID = [
    "",
    '{"ref_id":"zz@"}',
    '{"label":"","children":[{"label":" deep ","children":[{"ref_id":"@"},5,"x"]},{"ref_id":"@"}]}',
    '{"label":" Own ","ref_id":"@"}',
    '{"ref_id":7,"children":[{"ref_id":"@"}]}',
    '{"label":"empty","children":[]}',
    '{"children":[{"children":[{"children":[{"children":[{"ref_id":"@"}]}]}]}]}',
    '{"ref_id":"@"}',
]
#: What each region's response looks like around its tree.
FRAMES = ["not json [", '{"organizing_principle":"topical","tree":[]}', '{"organizing_principle":"Vibes","principle_rationale":" why ","tree":[@]}', '{"organizing_principle":"Chronological","principle_rationale":"time","tree":[null,@,3]}', '{"tree":[@]}']


def asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Responses (req_id, response) and references (req_id, ref_id, ord, source_filename, label), a request for each region."""
    found = T.references(nodes(spark, sf_dir)).withColumn("n", F.element_at("sort_key", -1))
    refs = found.select(F.col("doc_id").alias("req_id"), "ref_id", F.struct("sort_key").alias("ord"), F.concat(F.lit("n"), F.col("sort_key")[1], F.lit(".json")).alias("source_filename"), F.concat(F.lit(" "), "label").alias("label"), "n", "kind", "sort_key")
    refs = stored(refs, "aggregate-refs")
    said = F.replace(F.element_at(F.array(*map(F.lit, SAID)), (F.col("n") % len(SAID) + 1).cast("int")), F.lit("@"), F.col("ref_id"))
    listed = lambda items: F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda x: x["s"]), ",")
    sections = refs.where("kind = 'section'").withColumn("s", said)
    chapters = sections.groupBy("req_id", F.col("sort_key")[1].alias("nation")).agg(
        listed(F.when(F.col("s") != "", F.struct("n", "s"))).alias("inside"),
        listed(F.when(F.col("n") % 3 == 0, F.struct("n", F.concat(F.lit('{"ref_id":"'), "ref_id", F.lit('"}')).alias("s")))).alias("again"),
    )
    named = chapters.join(table(spark, sf_dir, "nation"), F.col("nation") == F.col("n_nationkey"))
    label = F.when(F.col("nation") % 3 == 0, "").otherwise(F.col("n_name"))
    both = named.select("req_id", "nation", F.concat(F.lit('{"label":"'), label, F.lit('","children":['), "inside", F.lit("]}")).alias("s"), F.concat(F.lit('{"label":"again","children":['), "again", F.lit("]}")).alias("t"))
    trees = both.groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("nation", "s", "t"))).alias("all"))
    tree = F.concat_ws(",", F.array_join("all.s", ","), F.array_join("all.t", ","))
    frame = F.element_at(F.array(*map(F.lit, FRAMES)), (F.substring("req_id", 2, 9).cast("int") % len(FRAMES) + 1))
    return stored(trees.select("req_id", F.replace(frame, F.lit("@"), tree).alias("response")), "aggregate-responses"), refs.select("req_id", "ref_id", "ord", "source_filename", "label")


_LIST = lambda items: "[" + ", ".join(f"'{s}'" for s in items) + "]"
TREES = f"""{NODES}, refs AS (SELECT doc_id AS req_id, doc_id || '::' || node_id AS ref_id, sort_key, 'n' || sort_key[2] || '.json' AS source, label, sort_key[-1] AS n, kind FROM nodes WHERE kind IN ('chapter', 'section')
), said AS (SELECT *, replace({_LIST(SAID)}[n % {len(SAID)} + 1], '@', ref_id) AS s FROM refs WHERE kind = 'section'
), chapters AS (SELECT req_id, sort_key[2] AS nation, coalesce(string_agg(s, ',' ORDER BY n) FILTER (s <> ''), '') AS inside, coalesce(string_agg('{{"ref_id":"' || ref_id || '"}}', ',' ORDER BY n) FILTER (n % 3 = 0), '') AS again FROM said GROUP BY ALL
), resp AS (SELECT req_id, replace({_LIST(FRAMES)}[substr(req_id, 2)::INT % {len(FRAMES)} + 1], '@', string_agg('{{"label":"' || CASE WHEN nation % 3 = 0 THEN '' ELSE n_name END || '","children":[' || inside || ']}}', ',' ORDER BY nation) || ',' || string_agg('{{"label":"again","children":[' || again || ']}}', ',' ORDER BY nation)) AS response
  FROM chapters JOIN nation ON n_nationkey = nation GROUP BY req_id
), ok AS (SELECT req_id, response::JSON AS v FROM resp WHERE CASE WHEN json_valid(response) THEN json_type(response) = 'OBJECT' AND json_array_length(response, '$.tree') > 0 ELSE false END
), walk AS (SELECT req_id, [i] AS pl, v->('$.tree[' || (i - 1) || ']') AS x FROM (SELECT *, unnest(range(1, json_array_length(v, '$.tree')::BIGINT + 1)) AS i FROM ok)
  UNION ALL SELECT req_id, list_append(pl, i), x->('$.children[' || (i - 1) || ']') FROM (SELECT *, unnest(range(1, json_array_length(x, '$.children')::BIGINT + 1)) AS i FROM walk
    WHERE json_type(x) = 'OBJECT' AND NOT coalesce(json_type(x, '$.ref_id') = 'VARCHAR', false) AND json_type(x, '$.children') = 'ARRAY' AND len(pl) < 4)
), seen AS (SELECT req_id, pl, coalesce(trim(x->>'$.label'), '') AS own, CASE WHEN json_type(x, '$.ref_id') = 'VARCHAR' THEN x->>'$.ref_id' END AS ref_id FROM walk WHERE json_type(x) = 'OBJECT'
), leaf AS (SELECT req_id, pl, CASE WHEN own = '' THEN label ELSE own END AS label, ref_id FROM seen JOIN refs USING (req_id, ref_id) QUALIFY row_number() OVER (PARTITION BY req_id, ref_id ORDER BY pl) = 1
), cat AS (SELECT DISTINCT s.req_id, s.pl, CASE WHEN own = '' THEN 'Categoria ' || s.pl[-1] ELSE own END AS label, NULL AS ref_id FROM seen s JOIN leaf l ON s.req_id = l.req_id AND s.ref_id IS NULL AND len(l.pl) > len(s.pl) AND l.pl[1:len(s.pl)] = s.pl
), placed AS (SELECT req_id, 'agg_' || array_to_string(pl, '_') AS node_id, CASE WHEN len(pl) = 1 THEN 'root' ELSE 'agg_' || array_to_string(pl[1:-2], '_') END AS parent_id, len(pl) AS level, CASE WHEN ref_id IS NOT NULL THEN 'ref' WHEN len(pl) = 1 THEN 'category' ELSE 'subcategory' END AS kind, label, ref_id FROM (FROM cat UNION ALL FROM leaf)
), miss AS (SELECT r.*, 'root_' || (1 + (SELECT count(*) FROM placed p WHERE p.req_id = r.req_id AND level = 1)) AS under FROM refs r SEMI JOIN ok USING (req_id) WHERE NOT EXISTS (SELECT 1 FROM leaf WHERE leaf.req_id = r.req_id AND leaf.ref_id = r.ref_id)
), lone AS (SELECT *, dense_rank() OVER (PARTITION BY req_id ORDER BY sort_key[2]) AS i, row_number() OVER (PARTITION BY req_id, source ORDER BY sort_key) AS j FROM refs WHERE req_id NOT IN (SELECT req_id FROM ok)
), tree AS (SELECT * FROM placed UNION ALL SELECT req_id, 'root', NULL, 0, 'root', NULL, NULL FROM resp
  UNION ALL SELECT DISTINCT req_id, under, 'root', 1, 'category', 'Senza categoria', NULL FROM miss UNION ALL SELECT req_id, under || '_' || row_number() OVER (PARTITION BY req_id ORDER BY sort_key), under, 2, 'ref', label, ref_id FROM miss
  UNION ALL SELECT DISTINCT req_id, 'agg_' || i, 'root', 1, 'category', replace(source, '.json', ''), NULL FROM lone UNION ALL SELECT req_id, 'agg_' || i || '_' || j, 'agg_' || i, 2, 'ref', label, ref_id FROM lone)"""


@query(f"WITH RECURSIVE {TREES} SELECT req_id, node_id, parent_id, level::INT AS level, kind, label, ref_id FROM tree")
def aggregate_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-document trees from nested responses: invented, repeated, dropped and too deep references, empty categories, fallback by source."""
    return A.trees(*asked(spark, sf_dir))


@query(f"""WITH RECURSIVE {TREES}, n AS (SELECT req_id, count(*) AS n_refs, count(DISTINCT source) AS n_sources FROM refs GROUP BY req_id), d AS (SELECT req_id, count(*) AS n_dropped FROM miss GROUP BY req_id
), h AS (SELECT req_id, response, coalesce(json_valid(response) AND json_type(CASE WHEN json_valid(response) THEN response END) = 'OBJECT', false) AS obj, req_id IN (SELECT req_id FROM ok) AS good, coalesce(lower(CASE WHEN json_valid(response) THEN response->>'$.organizing_principle' END), 'topical') AS said, CASE WHEN json_valid(response) THEN trim(response->>'$.principle_rationale') END AS why FROM resp)
SELECT req_id, CASE WHEN NOT good THEN 'structural' WHEN said IN ('chronological', 'topical', 'alphabetical', 'structural') THEN said ELSE 'topical' END AS principle, CASE WHEN NOT good THEN 'Fallback: aggregator LLM unavailable, grouped by source filename.' ELSE coalesce(nullif(why, ''), '(no rationale provided)') END AS rationale,
  n_sources, n_refs, coalesce(n_dropped, 0) AS n_dropped, concat_ws('; ', CASE WHEN NOT obj THEN 'aggregator LLM returned non-object response; using fallback' END, CASE WHEN obj AND said NOT IN ('chronological', 'topical', 'alphabetical', 'structural') THEN 'unknown organizing_principle ''' || said || '''; defaulting to topical' END,
  CASE WHEN obj AND NOT good THEN 'aggregator returned empty tree; using fallback' END, CASE WHEN n_dropped > 0 THEN 'aggregator dropped ' || n_dropped || ' refs; appended to ''Senza categoria''' END) AS warnings
FROM h JOIN n USING (req_id) LEFT JOIN d USING (req_id)""")
def aggregate_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the trees are organised by, why, over how many sources and references, and what was wrong."""
    return A.headers(*asked(spark, sf_dir)).withColumn("warnings", F.array_join("warnings", "; "))


@query(f"""WITH RECURSIVE {TREES} SELECT t.req_id, count(*) FILTER (kind <> 'root') AS n_nodes, count(ref_id) AS n_refs, string_agg(label, '|' ORDER BY node_id) FILTER (level = 1) AS labels FROM tree t GROUP BY t.req_id""")
def written_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-document trees written as JSON, a line each, and read back (K2)."""
    responses, refs = asked(spark, sf_dir)
    found = stored(A.trees(responses, refs), "trees")
    place = F.coalesce(F.regexp_extract("node_id", "([0-9]+)$", 1).try_cast("long"), F.lit(0).cast("long"))
    shaped = found.select(F.col("req_id").alias("doc_id"), "node_id", "parent_id", place.alias("child_ord"), F.array_repeat(F.lit("x"), F.col("level") + 1).alias("path"), "kind", "label", F.col("ref_id").alias("text"))
    path = scratch(spark, "aggregates")
    header = A.headers(responses, refs).withColumnRenamed("req_id", "doc_id")
    D.nested(shaped, 4).join(header, "doc_id").select(F.to_json(F.struct("doc_id", "principle", "rationale", "warnings", "tree")).alias("value")).write.text(path)
    read = spark.read.text(path).select(F.from_json("value", "doc_id string, tree string").alias("x")).select("x.doc_id", F.try_parse_json("x.tree").alias("v"))
    tops = F.try_variant_get("v", "$.children", "array<variant>")
    labels = F.array_join(F.transform(F.array_sort(F.transform(tops, lambda t: F.struct(F.try_variant_get(t, "$.node.node_id", "string").alias("id"), F.try_variant_get(t, "$.node.label", "string").alias("label")))), lambda x: x["label"]), "|")
    said = F.to_json("v")
    return read.select(F.col("doc_id").alias("req_id"), (F.regexp_count(said, F.lit('"node_id":')) - 1).cast("long").alias("n_nodes"), F.regexp_count(said, F.lit('"kind":"ref"')).cast("long").alias("n_refs"), labels.alias("labels"))


@query("""SELECT n_nationkey AS quiz, n_name AS filename, count(*) FILTER (c_custkey % 6 <> 0) AS n_produced, count(*) AS n_requested, coalesce(string_agg(c_name, '|' ORDER BY c_custkey) FILTER (c_custkey % 6 <> 0), '') AS fronts FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def written_quizzes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quizzes with their valid items written as JSON, a line each, and read back (K3)."""
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    item = F.struct(F.col("c_name").alias("front"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).otherwise(" ").alias("back"), *[F.lit(None).cast("string").alias(c) for c in ("question", "expected_answer", "correct_index")], F.lit(None).cast("array<string>").alias("key_points"), F.lit(None).cast("array<string>").alias("options"))
    rows = rows.withColumn("item", item).withColumn("good", Q.valid(F.lit("f"), F.col("item")))
    kept = F.array_sort(F.collect_list(F.when(F.col("good"), F.struct("c_custkey", F.struct("item.front", "item.back").alias("item")))))
    quizzes = rows.groupBy("n_nationkey", "n_name").agg(F.transform(kept, lambda x: x["item"]).alias("items"), F.count("*").alias("n_requested"))
    path = scratch(spark, "quizzes")
    quizzes.select(F.col("n_nationkey").alias("quiz"), F.struct(F.col("n_name").alias("filename")).alias("source"), F.struct("n_requested", F.size("items").alias("n_produced")).alias("metadata"), "items").write.json(path)
    read = spark.read.schema("quiz int, source struct<filename: string>, metadata struct<n_requested: long, n_produced: long>, items array<struct<front: string, back: string>>").json(path)
    return read.select("quiz", "source.filename", "metadata.n_produced", "metadata.n_requested", F.array_join("items.front", "|").alias("fronts"))
