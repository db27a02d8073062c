"""Queries over trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_label, fallback_label
from ..operators import tree as T
from ..sources.blocks import text_blocks
from .registry import query
from .relations import NODES, TEXT_BLOCKS, nodes, table

_MD = TEXT_BLOCKS + """, seen AS (
  SELECT *, coalesce(max(CASE WHEN level = 1 THEN ord END) OVER w, -1) AS h1, coalesce(max(CASE WHEN level = 2 THEN ord END) OVER w, -1) AS h2, coalesce(max(CASE WHEN level = 3 THEN ord END) OVER w, -1) AS h3
  FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), pathed AS (
  SELECT *, list_filter([CASE WHEN h1 > -1 AND (level = 0 OR level > 1) THEN h1 END, CASE WHEN h2 > h1 AND (level = 0 OR level > 2) THEN h2 END, CASE WHEN h3 > greatest(h1, h2) AND level = 0 THEN h3 END], lambda x: x IS NOT NULL) AS path FROM seen
), tree AS (
  SELECT doc_id, ord AS node, coalesce(path[-1], -1) AS parent, level::INT AS level, ['chapter', 'section', 'subsection'][level] AS kind, text, lo, hi, path FROM pathed WHERE level > 0
  UNION ALL SELECT doc_id, min(ord), coalesce(path[-1], -1), (len(path) + 1)::INT, 'paragraph', string_agg(text, chr(10) ORDER BY ord), min(lo), max(hi), path FROM pathed WHERE level = 0 GROUP BY doc_id, path
)"""


@query(f"WITH {_MD} SELECT doc_id, node, parent, level, kind, text, lo, hi, array_to_string(path, '/') AS path FROM tree")
def markdown_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and leaves of every text as a tree (A3)."""
    found = T.markdown_tree(text_blocks(table(spark, sf_dir, "documents")))
    return found.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "/"))


@query(f"WITH {_MD} SELECT doc_id, n AS node, min(lo) AS lo, max(hi) AS hi, count(*) AS leaves FROM (SELECT doc_id, unnest(path) AS n, lo, hi FROM tree WHERE kind = 'paragraph') GROUP BY doc_id, n")
def sealed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of inner nodes over their leaves (A1, A2)."""
    return T.sealed(T.markdown_tree(text_blocks(table(spark, sf_dir, "documents"))))


@query(f"""WITH {TEXT_BLOCKS}, s AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS section FROM blocks)
SELECT doc_id, section::BIGINT AS section, coalesce(string_agg(CASE WHEN kind = 'heading' THEN text END, chr(10) ORDER BY ord), '') AS title, coalesce(string_agg(CASE WHEN kind <> 'heading' THEN text END, chr(10) ORDER BY ord), '') AS body, count(*) AS n FROM s WHERE section > 0 GROUP BY doc_id, section""")
def slides_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by title."""
    return T.slides_tree(text_blocks(table(spark, sf_dir, "documents")))


@query(f"""WITH {NODES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY child_ord) AS k FROM nodes)
SELECT c.doc_id, c.node_id, CASE WHEN c.kind = 'chapter' THEN c.k::VARCHAR ELSE p.k || '.' || c.k END AS number FROM n c LEFT JOIN n p ON p.doc_id = c.doc_id AND p.node_id = c.parent_id WHERE c.kind IN ('chapter', 'section')""")
def numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of chapters and sections."""
    rows = nodes(spark, sf_dir).where(F.col("kind").isin("chapter", "section"))
    rows = rows.withColumn("path", F.slice("path", 2, 10))
    return T.numbered(rows).select("doc_id", "node_id", "number")


@query(f"""WITH {NODES} SELECT doc_id, a AS ancestor, count(*) FILTER (kind = 'paragraph') AS leaves, coalesce(sum(CASE WHEN kind = 'paragraph' THEN length(trim(text)) END), 0)::BIGINT AS chars, count(*) AS nodes, max(len(path) - place)::INT AS depth,
  coalesce(sum(CASE WHEN kind = 'paragraph' THEN length(trim(text)) END), 0) >= 100 AS enough FROM (SELECT *, unnest(path) AS a, generate_subscripts(path, 1) AS place FROM nodes) GROUP BY doc_id, a""")
def subtree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, text length, size and depth of every subtree, and the gate on its text."""
    return T.rollup(nodes(spark, sf_dir)).withColumn("enough", F.col("chars") >= 100)


@query(f"WITH {NODES} SELECT doc_id, a AS node_id, string_agg(text, chr(10) || chr(10) ORDER BY sort_key) AS text FROM (SELECT doc_id, unnest(path[:3]) AS a, sort_key, text FROM nodes WHERE kind = 'paragraph' AND trim(text) <> '') WHERE a[1] = 'c' GROUP BY doc_id, a")
def collected_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts below each section in document order (A4)."""
    return T.collected_text(nodes(spark, sf_dir)).where(F.col("node_id").startswith("c"))


@query(f"""WITH {NODES}, kept AS (SELECT DISTINCT doc_id, unnest(path) AS node_id FROM nodes WHERE kind = 'paragraph' AND trim(text) <> '') SELECT doc_id, node_id, kind FROM nodes SEMI JOIN kept USING (doc_id, node_id)""")
def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees without blank leaves and empty branches (P5)."""
    return T.pruned(nodes(spark, sf_dir)).select("doc_id", "node_id", "kind")


@query(f"""WITH {NODES}, k AS (SELECT n.*, EXISTS (SELECT 1 FROM nodes c WHERE c.doc_id = n.doc_id AND c.parent_id = n.node_id) AS inner_ FROM nodes n)
SELECT doc_id, node_id, 'leaf isn''t a paragraph' AS issue FROM k WHERE NOT inner_ AND kind <> 'paragraph' UNION ALL SELECT doc_id, node_id, 'leaf without text' FROM k WHERE NOT inner_ AND coalesce(trim(text), '') = '' UNION ALL SELECT doc_id, node_id, 'inner node with text' FROM k WHERE inner_ AND trim(text) <> ''""")
def structural_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks a tree's contract."""
    return T.issues(nodes(spark, sf_dir))


@query(f"""WITH {NODES}, ch AS (SELECT doc_id, parent_id, count(*) AS n, min(kind) AS kid FROM nodes WHERE parent_id IS NOT NULL GROUP BY doc_id, parent_id
), gone AS (SELECT s.doc_id, s.node_id FROM nodes s JOIN ch ON ch.doc_id = s.doc_id AND ch.parent_id = s.node_id WHERE n = 1 AND kid <> 'paragraph' AND s.parent_id IS NOT NULL), steps AS (SELECT k.doc_id, node_id, unnest(path) AS up, generate_subscripts(path, 1) AS place FROM nodes k ANTI JOIN gone USING (doc_id, node_id)
), p AS (SELECT s.doc_id, s.node_id, list(up ORDER BY place) AS path FROM steps s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.node_id = s.up WHERE g.node_id IS NULL GROUP BY s.doc_id, s.node_id)
SELECT doc_id, node_id, CASE WHEN len(path) > 1 THEN path[-2] END AS parent_id, (len(path) - 1)::INT AS level FROM p""")
def collapsed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees without single-child chains."""
    return T.collapsed(nodes(spark, sf_dir))


@query(f"WITH {NODES} SELECT doc_id, node_id, CASE WHEN len(path) - 1 > 2 THEN path[3] ELSE parent_id END AS parent_id, least(len(path) - 1, 3)::INT AS level FROM nodes WHERE len(path) - 1 <= 2 OR kind = 'paragraph'")
def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees cut to a depth, their leaves kept."""
    return T.flattened(nodes(spark, sf_dir), 2)


_PICK = "(SELECT doc_id, node_id FROM nodes WHERE (kind = 'chapter' AND child_ord % 4 = 0) OR (kind = 'section' AND child_ord % 7 = 0) OR (kind = 'paragraph' AND child_ord % 5 = 0))"


def _picked(rows: DataFrame) -> DataFrame:
    k, n = F.col("kind"), F.col("child_ord")
    return rows.where(((k == "chapter") & (n % 4 == 0)) | ((k == "section") & (n % 7 == 0)) | ((k == "paragraph") & (n % 5 == 0))).select("doc_id", "node_id")


@query(f"WITH {NODES}, pick AS {_PICK} SELECT doc_id, node_id FROM nodes n SEMI JOIN pick USING (doc_id, node_id) WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(n.path[:-2]) AS up) u JOIN pick ON pick.node_id = up AND pick.doc_id = n.doc_id)")
def undominated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection without nodes below other selected ones."""
    rows = nodes(spark, sf_dir)
    return T.undominated(_picked(rows), rows)


@query(f"""WITH {NODES}, pick AS {_PICK}, d AS (SELECT doc_id, unnest(path) AS a, node_id FROM nodes) SELECT d.doc_id, a AS node_id, count(p.node_id) AS picked, count(*) AS size, CASE WHEN count(p.node_id) = count(*) THEN 'checked' WHEN count(p.node_id) > 0 THEN 'indeterminate' ELSE 'unchecked' END AS state
FROM d LEFT JOIN pick p ON p.doc_id = d.doc_id AND p.node_id = d.node_id GROUP BY d.doc_id, a""")
def tri_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each subtree is selected."""
    rows = nodes(spark, sf_dir)
    return T.tri_state(_picked(rows), rows)


_REFS = "refs AS (SELECT n.doc_id || '::' || n.node_id AS ref_id, n.doc_id, n.node_id, n.kind, n.label, p.label AS parent_label, n.sort_key FROM nodes n LEFT JOIN nodes p ON p.doc_id = n.doc_id AND p.node_id = n.parent_id WHERE n.kind IN ('chapter', 'section'))"


@query(f"WITH {NODES}, {_REFS} SELECT ref_id, kind, label, parent_label, '{{\"doc_id\":\"' || doc_id || '\",\"node_id\":\"' || node_id || '\",\"label\":\"' || label || '\"}}' AS payload FROM refs")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referable sections with their payload."""
    return T.references(nodes(spark, sf_dir)).select("ref_id", "kind", "label", "parent_label", F.to_json(F.struct("doc_id", "node_id", "label")).alias("payload"))


@query(f"""WITH {NODES}, {_REFS}, r AS (SELECT ref_id, doc_id || '.json' AS source_filename, row_number() OVER (ORDER BY sort_key, ref_id) AS ord FROM refs), s AS (SELECT source_filename, row_number() OVER (ORDER BY min(ord)) AS i, count(*) AS n_refs FROM r GROUP BY source_filename)
SELECT 'agg_' || i || '_' || row_number() OVER (PARTITION BY source_filename ORDER BY ord) AS node_id, regexp_replace(source_filename, '\\.[^.]*$', '') AS category, ref_id, n_refs FROM r JOIN s USING (source_filename)""")
def aggregate_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References grouped by source."""
    refs = T.references(nodes(spark, sf_dir)).select("ref_id", F.concat("doc_id", F.lit(".json")).alias("source_filename"), F.struct("sort_key", "ref_id").alias("ord"))
    return T.aggregate_fallback(refs)


@query(f"""WITH {NODES}, {_REFS}, resp AS (SELECT ref_id, 'topic ' || (sort_key[-1] % 3) AS category, sort_key[-1] AS pos FROM refs WHERE sort_key[-1] % 4 <> 0 UNION ALL SELECT ref_id, 'again', 1000000 FROM refs WHERE sort_key[-1] % 5 = 0 UNION ALL SELECT 'invented::' || ref_id, 'topic 0', 5 FROM refs WHERE sort_key[-1] % 6 = 0
), known AS (SELECT ref_id, category FROM resp SEMI JOIN refs USING (ref_id) QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY pos) = 1)
SELECT * FROM known UNION ALL SELECT ref_id, 'Senza categoria' FROM refs ANTI JOIN known USING (ref_id)""")
def placed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response's tree: invented references dropped, repeated ones once, missing ones in the catch-all."""
    refs = T.references(nodes(spark, sf_dir))
    n = F.element_at("sort_key", -1)
    response = refs.where(n % 4 != 0).select("ref_id", F.concat(F.lit("topic "), n % 3).alias("category"), n.alias("pos"))
    response = response.unionByName(refs.where(n % 5 == 0).select("ref_id", F.lit("again").alias("category"), F.lit(1000000).cast("long").alias("pos")))
    response = response.unionByName(refs.where(n % 6 == 0).select(F.concat(F.lit("invented::"), "ref_id").alias("ref_id"), F.lit("topic 0").alias("category"), F.lit(5).cast("long").alias("pos")))
    return T.placed(refs, response)


@query(f"""WITH {NODES}, o AS (SELECT node_id, parent_id, len(path) - 1 AS level, kind, label FROM nodes WHERE doc_id = 'd0' AND kind <> 'paragraph'), n AS (SELECT node_id, parent_id, len(path) - 1 AS level, kind, label FROM nodes WHERE doc_id = 'd1' AND kind <> 'paragraph')
SELECT node_id, parent_id, level::INT AS level, kind, label FROM o UNION ALL SELECT 's1_' || node_id, CASE WHEN parent_id = 'r1' THEN 's1_root' ELSE 's1_' || parent_id END, (level + 1)::INT, kind, label FROM n WHERE parent_id IS NOT NULL UNION ALL SELECT 's1_root', 'r0', 1, 'chapter', 'second'""")
def merged_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree appended to another under a chapter of its own."""
    rows = nodes(spark, sf_dir).where("kind <> 'paragraph'").withColumn("level", F.size("path") - 1)
    return T.merged(rows.where("doc_id = 'd0'"), rows.where("doc_id = 'd1'"), "second")


@query(f"WITH {NODES} SELECT doc_id, node_id, repeat('  ', greatest(len(path) - 2, 0)::INT) || CASE WHEN kind = 'root' THEN 'All document' ELSE label END AS line, len(path) <= 2 AS expanded, row_number() OVER (PARTITION BY doc_id ORDER BY sort_key) AS place FROM nodes WHERE kind <> 'paragraph'")
def picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees in pre-order as indented lines."""
    w = T.Window.partitionBy("doc_id").orderBy("sort_key")
    rows = nodes(spark, sf_dir).where("kind <> 'paragraph'")
    line = F.concat(F.expr("repeat('  ', greatest(size(path) - 2, 0))"), F.when(F.col("kind") == "root", "All document").otherwise(F.col("label")))
    return rows.select("doc_id", "node_id", line.alias("line"), (F.size("path") <= 2).alias("expanded"), F.row_number().over(w).cast("long").alias("place"))


@query(f"""WITH {NODES}, l AS (SELECT doc_id, path[3] AS node_id, sort_key, trim(text) AS t FROM nodes WHERE kind = 'paragraph' AND trim(text) <> ''), u AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY doc_id, node_id ORDER BY sort_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM l
), x AS (SELECT doc_id, node_id, string_agg(substr(t, 1, (60 - used)::INT), ' ' ORDER BY sort_key) AS excerpt FROM u WHERE used < 60 GROUP BY doc_id, node_id)
SELECT doc_id, node_id, excerpt, array_to_string(regexp_split_to_array(excerpt, '\\s+')[1:6], ' ') AS fallback, '"' || excerpt || '"' AS raw FROM x""")
def section_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf texts up to a budget of characters, and labels made from them."""
    rows = nodes(spark, sf_dir).where("kind = 'paragraph' and trim(text) <> ''").select("doc_id", F.col("path")[2].alias("node_id"), "sort_key", F.trim("text").alias("t"))
    w = T.Window.partitionBy("doc_id", "node_id").orderBy("sort_key").rowsBetween(T.Window.unboundedPreceding, -1)
    rows = rows.withColumn("used", F.coalesce(F.sum(F.length("t")).over(w), F.lit(0))).where("used < 60")
    rows = rows.withColumn("t", F.expr("substring(t, 1, cast(60 - used as int))"))
    out = rows.groupBy("doc_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_key", "t"))), lambda s: s["t"]), " ").alias("excerpt"))
    raw = F.concat(F.lit('"'), clean_label(F.concat(F.lit('"'), "excerpt", F.lit('".'))), F.lit('"'))
    return out.select("doc_id", "node_id", "excerpt", fallback_label(F.col("excerpt"), F.lit("section")).alias("fallback"), raw.alias("raw"))


_RANGES = """items AS (SELECT o_custkey AS doc_id, 'o' || o_orderkey AS item_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord FROM orders
), ranges AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE 'o' || o_orderkey END AS start_id, 'o' || lead(o_orderkey, (o_orderkey % 4)::INT, o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS end_id FROM orders WHERE o_custkey % 3 <> 0
), good AS (SELECT r.doc_id, pos, s.ord AS lo, e.ord AS hi FROM ranges r JOIN items s ON s.doc_id = r.doc_id AND s.item_id = start_id JOIN items e ON e.doc_id = r.doc_id AND e.item_id = end_id WHERE s.ord <= e.ord
), valid AS (SELECT * FROM good UNION ALL SELECT doc_id, ord, ord, ord FROM items ANTI JOIN good USING (doc_id))"""


def _ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w = T.Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    items = orders.select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("o"), "o_orderkey").alias("item_id"), (F.row_number().over(w) - 1).cast("long").alias("ord"))
    k = F.col("o_orderkey")
    end = F.coalesce(*[F.when(k % 4 == n, F.coalesce(F.lead("o_orderkey", n).over(w), k)) for n in range(1, 4)], k)
    rows = orders.where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("doc_id"), k.alias("pos"), F.when(k % 7 == 0, "unknown").otherwise(F.concat(F.lit("o"), k)).alias("start_id"), F.concat(F.lit("o"), end).alias("end_id"))
    return rows, items


@query(f"WITH {_RANGES} SELECT doc_id, pos, lo, hi FROM valid QUALIFY row_number() OVER (PARTITION BY doc_id, lo ORDER BY pos) = 1")
def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid ranges, one for each start."""
    return T.segmented(T.valid_ranges(*_ranges(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_RANGES}, o AS (SELECT doc_id, lo, hi, row_number() OVER (PARTITION BY doc_id ORDER BY lo, pos) AS k FROM valid), walk AS (SELECT doc_id, lo, hi, k, true AS kept, hi AS last FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.lo, o.hi, o.k, o.lo > w.last, CASE WHEN o.lo > w.last THEN o.hi ELSE w.last END FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k + 1)
SELECT w.doc_id, w.lo, w.hi, count(*) AS members FROM walk w JOIN items i ON i.doc_id = w.doc_id AND i.ord BETWEEN w.lo AND w.hi WHERE kept GROUP BY w.doc_id, w.lo, w.hi""")
def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that don't overlap those kept before, and their members."""
    ranges, items = _ranges(spark, sf_dir)
    kept = T.uncovered(T.valid_ranges(ranges, items))
    return T.members(kept, items).groupBy("doc_id", "lo", "hi").agg(F.count("*").alias("members"))


@query(f"""WITH RECURSIVE {_RANGES}, valid2 AS (SELECT * FROM valid WHERE doc_id % 6 <> 0 OR (SELECT count(*) FROM items i WHERE i.doc_id = valid.doc_id) = 1), o AS (SELECT doc_id, lo, hi, row_number() OVER (PARTITION BY doc_id ORDER BY lo, pos) AS k FROM valid2
), walk AS (SELECT doc_id, lo, hi, k, true AS kept, hi AS last FROM o WHERE k = 1 UNION ALL SELECT o.doc_id, o.lo, o.hi, o.k, o.lo > w.last, CASE WHEN o.lo > w.last THEN o.hi ELSE w.last END FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k + 1
), sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM items WHERE doc_id % 6 = 0
), chunks AS (SELECT doc_id, min(ord) AS lo, max(ord) AS hi FROM (SELECT *, CASE WHEN n <= 12 THEN 0 ELSE ord // greatest(1, n // 12) END AS c FROM sized WHERE n > 1) GROUP BY doc_id, c
), sec AS (SELECT doc_id, lo, hi, row_number() OVER (PARTITION BY doc_id ORDER BY lo) AS section, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, lo, hi FROM walk WHERE kept UNION ALL SELECT * FROM chunks))
SELECT i.doc_id, i.item_id, section, CASE WHEN n > 8 THEN (section - 1) // greatest(1, n // 8) + 1 END AS chapter, CASE WHEN n > 8 THEN 3 ELSE 2 END AS level FROM sec s JOIN items i ON i.doc_id = s.doc_id AND i.ord BETWEEN s.lo AND s.hi""")
def clustered_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in sections, and where there are over eight of these in chapters, in chunks where a response is missing."""
    ranges, items = _ranges(spark, sf_dir)
    failed = items.where("doc_id % 6 = 0").select("doc_id").distinct()
    none = ranges.limit(0)
    return T.two_passes(items, ranges, failed, none, items.select("doc_id").distinct())
