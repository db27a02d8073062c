"""Queries over markdown, from the scanner to the tree at its final depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tree as T
from ..session import stored
from ..sources.markdown import markdown_blocks
from .registry import query
from .relations import table

# What the SQL takes for the lines of each kind; the texts below hold no others.
FENCE = r"^ {0,3}(```|~~~)"
QUOTE = r"^( {0,3}> ?)+"
HEADING = r"^ {0,3}(#{1,6})([ \t]|$)"
ITEM = r"^\s*([-*+]|[0-9]{1,9}[.)])([ \t]+|$)"
NUMBERED = r"^\s*[0-9]"
RULE = r"^ {0,3}((\* *){3,}|(- *){3,}|(_ *){3,})$"
UNDERLINE = r"^ {0,3}(=+|-+)[ \t]*$"
TAG = r"(?i)^ {0,3}<(!--|/?(div|p|table|tr|td|ul|ol|li|h[1-6]|section|article|pre|script|style|details|summary|iframe|form|hr|br)\b)"

#: How the lines of a text become markdown, one after the other, again and again.
SHAPES = ["# {}", "{}", "{}", "", "- {}", "  {}", "- {}", "", "  {}", "```", "# {}", "```", "{}", "===", "> {}", "{}", "", "    {}", "", "### {} ##", "1. {}", "---", "{}", "## {}", "#### {}", "##### {}", "<div>", "{}", "", "###### {}", "{}", "+ {}", "", "{}", "***", "{}", "---"]


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text: every document's lines as markdown."""
    shapes = F.array(*map(F.lit, SHAPES))
    shaped = F.transform(F.split("text", "\n"), lambda line, i: F.replace(F.element_at(shapes, i % len(SHAPES) + 1), F.lit("{}"), line))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(shaped, "\n").alias("text"))


_SHAPES = "[" + ", ".join(f"'{s}'" for s in SHAPES) + "]"
_UPTO = "OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BEFORE = "OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_FIND = lambda pattern: f"regexp_matches(body, '{pattern}')"
MD_BLOCKS = rf"""raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), l0 AS (SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS src FROM raw
), l1 AS (SELECT doc_id, n, replace({_SHAPES}[n % {len(SHAPES)} + 1], '{{}}', src) AS line FROM l0
), l2 AS (SELECT *, coalesce(sum(length(line) + 1) {_BEFORE}, 0)::BIGINT AS lo, regexp_matches(line, '{FENCE}') AS fence, regexp_matches(line, '{QUOTE}') AS quote, regexp_replace(line, '{QUOTE}', '') AS body FROM l1
), l3 AS (SELECT *, fence OR coalesce(sum(fence::INT) {_BEFORE}, 0) % 2 = 1 AS code, NOT regexp_matches(body, '\S') AS blank, length(regexp_extract(replace(body, chr(9), '    '), '^ *')) AS indent FROM l2
), l4 AS (SELECT *, CASE WHEN code THEN 0 ELSE length(regexp_extract(body, '{HEADING}', 1)) END AS level, NOT code AND {_FIND(RULE)} AS rule FROM l3
), l5 AS (SELECT *, NOT code AND NOT rule AND {_FIND(ITEM)} AS mark FROM l4
), l6 AS (SELECT *, NOT (code OR blank OR rule OR mark OR level > 0) AS plain FROM l5
), l7 AS (SELECT *, coalesce(last_value(CASE WHEN NOT (plain AND indent >= 4) THEN plain OR mark END IGNORE NULLS) {_BEFORE}, false) AND NOT (quote AND NOT coalesce(lag(quote) OVER (PARTITION BY doc_id ORDER BY n), false)) AS goes_on FROM l6
), l8 AS (SELECT *, coalesce(last_value(CASE WHEN blank THEN false WHEN plain AND NOT goes_on AND {_FIND(TAG)} THEN true END IGNORE NULLS) {_UPTO}, false) AS html,
  CASE WHEN mark THEN true WHEN indent < 2 AND ((plain AND NOT goes_on) OR level > 0 OR rule) THEN false END AS says FROM l7
), l9 AS (SELECT *, coalesce(last_value(says IGNORE NULLS) {_UPTO}, false) AS listed, coalesce(last_value(CASE WHEN NOT rule THEN says END IGNORE NULLS) {_UPTO}, false) AS was FROM l8
), l10 AS (SELECT *, NOT code AND goes_on AND NOT was AND NOT html AND {_FIND(UNDERLINE)} AS under FROM l9
), l11 AS (SELECT *, plain AND NOT html AND NOT under AND NOT (NOT goes_on AND indent >= 4 AND NOT listed) AS words FROM l10
), l12 AS (SELECT *, level > 0 OR mark OR (words AND NOT goes_on) AS starts FROM l11
), l13 AS (SELECT *, sum(starts::INT) {_UPTO} AS block, last_value(CASE WHEN mark THEN {_FIND(NUMBERED)} END IGNORE NULLS) {_UPTO} AS numbered, trim(CASE WHEN mark THEN regexp_replace(body, '{ITEM}', '') WHEN level > 0 THEN regexp_replace(regexp_replace(body, '^\s*#{{1,6}}[ \t]*', ''), '(^|[ \t]+)#+[ \t]*$', '') ELSE body END) AS said FROM l12
), g AS (SELECT doc_id, block, arg_min(level, n) AS level, arg_min(mark, n) AS mark, arg_min(listed, n) AS listed, arg_min(numbered, n) AS numbered, coalesce(string_agg(said, chr(10) ORDER BY n) FILTER (NOT under), '') AS text,
  max(CASE WHEN under THEN CASE WHEN {_FIND('^ {0,3}=')} THEN 1 ELSE 2 END END) AS below, min(lo) AS lo, max(lo + length(line)) AS hi FROM l13 WHERE starts OR words OR under GROUP BY doc_id, block
), k AS (SELECT *, CASE WHEN level > 0 THEN level ELSE coalesce(below, 0) END AS deep FROM g
), blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS ord, CASE WHEN deep > 0 THEN 'heading' WHEN listed THEN 'list_item' ELSE 'paragraph' END AS kind, deep::BIGINT AS level,
  CASE WHEN deep = 0 AND listed THEN CASE WHEN numbered THEN 'ordered' ELSE 'bullet' END END AS list_kind, text, lo, hi FROM k WHERE text <> '' OR deep > 0)"""


@query(f"WITH {MD_BLOCKS} SELECT * FROM blocks")
def markdown_blocks_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown as headings, list items and paragraphs over their lines, with ranges."""
    return markdown_blocks(markdown(spark, sf_dir))


#: Shapes with lists in lists, fences within longer or other fences, and lists that begin at two; each text begins at another one.
NESTED = ["- {}", "  - {}", "- {}", "", "2. {}", "{}", "```", "~~~", "# {}", "```", "## {}", "````", "```", "{}", "````", "{}", "3. {}", "", "4. {}", "   + {}", "", "     {}", "   + {}", "5. {}", "{}", "~~~", "``` {}", "~~~~", "", "- {}", "  ```", "  {}", "{}", "", "1) {}", "   2. {}", "", "   7. {}", "      {}", "        {}", "     {}", "- {}", "    {}", "", "        {}", "{}", "", "      {}", "+ {}", "# {}"]
_NESTED = "[" + ", ".join(f"'{s}'" for s in NESTED) + "]"


@query(rf"""WITH RECURSIVE src AS (SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS said FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
), ls AS (SELECT doc_id, n, line, (coalesce(sum(length(line) + 1) {_BEFORE}, 0))::BIGINT AS lo FROM (SELECT doc_id, n, replace({_NESTED}[(n + doc_id) % {len(NESTED)} + 1], '{{}}', 'w' || rtrim(regexp_replace(' ' || said, '[^A-Za-z]+', ' ', 'g'))) AS line FROM src)
), rec AS (
  SELECT DISTINCT doc_id, 0::BIGINT AS n, []::STRUCT(w BIGINT, m VARCHAR)[] AS stack, '' AS fence, 0::BIGINT AS flen, 0::BIGINT AS fd, false AS para, NULL::VARCHAR AS listed, 0::BIGINT AS block, false AS member, 0::BIGINT AS level, ''::VARCHAR AS said, 0::BIGINT AS lo, 0::BIGINT AS hi FROM ls
  UNION ALL
  SELECT doc_id, n + 1, nstack, CASE WHEN closing THEN '' WHEN opener THEN rest[1] WHEN inside OR blank THEN fence ELSE '' END, CASE WHEN opener THEN length(regexp_extract(rest, '^(`+|~+)', 1)) ELSE flen END, CASE WHEN opener THEN k ELSE fd END,
    item OR starts OR goes, nlisted, block + (item OR head OR starts)::INT, item OR head OR starts OR goes, CASE WHEN head THEN length(regexp_extract(rest, '^#+')) ELSE 0 END,
    CASE WHEN item THEN substr(rest, length(mark) + 2) WHEN head THEN regexp_replace(rest, '^#+ ?', '') WHEN goes THEN repeat(' ', r) || rest ELSE rest END, own, own + length(line)
  FROM (SELECT *, CASE WHEN item THEN list_concat(stack[1:k], [{{'w': (ind + length(mark) + 1)::BIGINT, 'm': right(mark, 1)}}]) WHEN opener OR head OR code OR starts THEN stack[1:k] ELSE stack END AS nstack,
      CASE WHEN item AND k < len(stack) AND stack[k + 1].m = right(mark, 1) THEN CASE WHEN len(stack) = k + 1 THEN listed END WHEN item THEN CASE WHEN length(mark) > 1 THEN 'ordered' ELSE 'bullet' END
        WHEN (opener OR head OR code OR starts) AND k < len(stack) THEN NULL ELSE listed END AS nlisted
    FROM (SELECT *, text AND r >= 4 AND NOT para AS code, text AND para AS goes, text AND NOT para AND r < 4 AS starts
      FROM (SELECT *, NOT (inside OR blank OR opener OR head OR item) AS text
        FROM (SELECT *, inside AND r < 4 AND regexp_matches(rest, '^[`~]+$') AND rest[1] = fence AND length(rest) >= flen AS closing, free AND regexp_matches(rest, '^(```+[^`]*|~~~+.*)$') AS opener, free AND regexp_matches(rest, '^#{{1,6}}( |$)') AS head,
            free AND mark <> '' AND NOT (para AND k = len(stack) AND length(mark) > 1 AND mark NOT IN ('1.', '1)')) AS item
          FROM (SELECT *, NOT inside AND NOT blank AND r < 4 AS free, regexp_extract(rest, '^([-+*]|[0-9]{{1,9}}[.)]) ', 1) AS mark
            FROM (SELECT *, fence <> '' AND k >= fd AS inside FROM (SELECT *, ind - CASE WHEN k > 0 THEN stack[k].w ELSE 0 END AS r
              FROM (SELECT *, CASE WHEN blank THEN len(stack) ELSE len(list_filter(stack, lambda x: x.w <= ind)) END AS k
                FROM (SELECT rec.*, line, ls.lo AS own, length(line) - length(ltrim(line)) AS ind, ltrim(line) AS rest, line = '' AS blank FROM rec JOIN ls USING (doc_id, n))))))))))
), g AS (SELECT doc_id, block, arg_min(level, n) AS level, arg_min(listed, n) AS listed, trim(string_agg(said, chr(10) ORDER BY n), ' ' || chr(10)) AS text, min(lo) AS lo, max(hi) AS hi FROM rec WHERE member GROUP BY doc_id, block)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS ord, CASE WHEN level > 0 THEN 'heading' WHEN listed IS NULL THEN 'paragraph' ELSE 'list_item' END AS kind, level, CASE WHEN level = 0 THEN listed END AS list_kind, text, lo, hi FROM g""")
def nested_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in lists, lists that begin at two and fences within fences, by a stack of containers (S3)."""
    shapes = F.array(*map(F.lit, NESTED))
    said = lambda line: F.concat(F.lit("w"), F.rtrim(F.regexp_replace(F.concat(F.lit(" "), line), "[^A-Za-z]+", " ")))
    shaped = F.transform(F.split("text", "\n"), lambda line, i: F.replace(F.element_at(shapes, ((i + F.col("doc_id")) % len(NESTED) + 1).cast("int")), F.lit("{}"), said(line)))
    return markdown_blocks(table(spark, sf_dir, "documents").select("doc_id", F.array_join(shaped, "\n").alias("text")))


_LEVELS = range(1, 7)
_SEEN = ", ".join(f"coalesce(max(CASE WHEN level = {k} THEN ord END) OVER w, -1) AS h{k}" for k in _LEVELS)
_OPEN = ", ".join(f"CASE WHEN h{k} > {'greatest(' + ', '.join(['-1', *(f'h{j}' for j in range(1, k))]) + ')' if k > 1 else '-1'} AND (level = 0 OR level > {k}) THEN h{k} END" for k in _LEVELS)
OUTLINE = MD_BLOCKS + f""", seen AS (SELECT *, {_SEEN} FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), pathed AS (SELECT *, list_filter([{_OPEN}], lambda x: x IS NOT NULL) AS path FROM seen
), tree AS (SELECT doc_id, ord AS node, path, ['chapter', 'section', 'subsection'][least(level, 3)] AS kind, level::INT AS level, text, lo, hi FROM pathed WHERE level > 0
  UNION ALL SELECT doc_id, min(ord), path, 'paragraph', (len(path) + 1)::INT, string_agg(text, chr(10) ORDER BY ord), min(lo), max(hi) FROM pathed WHERE level = 0 GROUP BY doc_id, path)"""


@query(f"WITH {OUTLINE} SELECT doc_id, node, coalesce(path[-1], -1) AS parent, level, kind, text, lo, hi, array_to_string(path, '/') AS path FROM tree")
def markdown_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of all six levels of headings, with the blocks between as leaves."""
    found = T.markdown_tree(markdown_blocks(markdown(spark, sf_dir)), 6)
    return found.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "/"))


def outline_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outlines' nodes below a root for each document: doc_id, node_id, parent_id, kind, label, text, path."""
    found = T.markdown_tree(markdown_blocks(markdown(spark, sf_dir)), 6)
    name = lambda x: F.concat(F.lit("b"), x)
    leaf = F.col("kind") == "paragraph"
    # a leaf is named apart, as one before all headings begins like the root's first block
    own = F.concat(F.when(leaf, "p").otherwise("b"), "node")
    path = F.concat(F.array(F.lit("root")), F.transform("path", name), F.array(own))
    rows = found.select("doc_id", own.alias("node_id"), F.element_at(path, -2).alias("parent_id"), "kind", F.when(~leaf, F.col("text")).alias("label"), F.when(leaf, F.col("text")).alias("text"), path.alias("path"))
    root = found.select("doc_id").distinct().select("doc_id", F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("root").alias("kind"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("text"), F.array(F.lit("root")).alias("path"))
    return root.unionByName(rows)


@query(f"""WITH {OUTLINE}, nd AS (SELECT doc_id, CASE WHEN kind = 'paragraph' THEN 'p' ELSE 'b' END || node AS node_id, kind, list_concat(['root'], list_transform(path, lambda x: 'b' || x), [CASE WHEN kind = 'paragraph' THEN 'p' ELSE 'b' END || node]) AS path FROM tree UNION ALL SELECT DISTINCT doc_id, 'root', 'root', ['root'] FROM tree
), one AS (SELECT doc_id, path[-2] AS node_id FROM nd WHERE len(path) > 1 GROUP BY doc_id, path[-2] HAVING count(*) = 1 AND min(kind) <> 'paragraph' AND path[-2] <> 'root'
), up AS (SELECT doc_id, node_id, kind, unnest(path) AS a, unnest(range(len(path))) AS place FROM nd ANTI JOIN one USING (doc_id, node_id)
), short AS (SELECT doc_id, node_id, kind, list(a ORDER BY place) AS path FROM up WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.doc_id = up.doc_id AND one.node_id = up.a) GROUP BY doc_id, node_id, kind
), dp AS (SELECT *, max(len(path) - 1) OVER (PARTITION BY doc_id) AS depth FROM short
), fl AS (SELECT doc_id, node_id, kind, depth, CASE WHEN len(path) - 1 > 4 THEN list_concat(path[1:5], [node_id]) ELSE path END AS path FROM dp WHERE len(path) - 1 <= 4 OR kind = 'paragraph')
SELECT doc_id, node_id, kind, CASE WHEN len(path) > 1 THEN path[-2] END AS parent_id, (len(path) - 1)::INT AS level, CASE WHEN depth > 4 THEN 'natural depth ' || depth || ' exceeded max (4); flattened' END AS warning FROM fl""")
def decided_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines without single-child chains, at most four levels deep, with a warning where flattened."""
    return T.decided_depth(stored(outline_nodes(spark, sf_dir).drop("label", "text"), "outline")).select("doc_id", "node_id", "kind", "parent_id", "level", "warning")
