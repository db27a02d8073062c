"""Trees as adjacency relations with materialised paths.

A node has doc_id, node_id, parent_id (null for the root), child_ord, kind, label, text and path, the ids from the root
to the node. Paths turn subtree and ancestor questions into joins on exploded paths, which partition by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import format_level, stripped
from ..session import stored
from ..sources.blocks import fallback_chunks


def markdown_tree(blocks: DataFrame, levels: int = 3) -> DataFrame:
    """Nodes of blocks with headings of levels 1 to `levels`: doc_id, node, parent, level, kind, text, lo, hi, path.

    A heading hangs below the last one of a smaller level; what follows a heading up to the next is one leaf below
    it. node is the order of the node's first block, parent -1 is the root, path the open headings above.
    """
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks
    for k in range(1, levels + 1):
        rows = rows.withColumn(f"h{k}", F.coalesce(F.last(F.when(F.col("level") == k, F.col("ord")), ignorenulls=True).over(w), F.lit(-1)))
    open_ = []
    for k in range(1, levels + 1):  # a heading is open until one of its level or a smaller one comes
        above = F.greatest(F.lit(-1), F.lit(-1), *[F.col(f"h{j}") for j in range(1, k)])
        below = (F.col("level") == 0) | (F.col("level") > k)
        open_.append(F.when((F.col(f"h{k}") > above) & below, F.col(f"h{k}")))
    rows = rows.withColumn("path", F.filter(F.array(*open_), lambda x: x.isNotNull()))
    rows = rows.withColumn("parent", F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(-1).cast("long")))
    head = rows.where("level > 0").select("doc_id", F.col("ord").alias("node"), "parent", F.col("level").cast("int").alias("level"), F.element_at(F.array(F.lit("chapter"), F.lit("section"), F.lit("subsection")), F.least(F.col("level"), F.lit(3)).cast("int")).alias("kind"), "text", "lo", "hi", "path")
    body = rows.where("level = 0").groupBy("doc_id", "parent", "path").agg(F.min("ord").alias("node"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "\n").alias("text"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return head.unionByName(body.select("doc_id", "node", "parent", (F.size("path") + 1).cast("int").alias("level"), F.lit("paragraph").alias("kind"), "text", "lo", "hi", "path"))


def sealed(nodes: DataFrame) -> DataFrame:
    """For each inner node of a markdown tree the range over all leaves below it."""
    leaves = nodes.where("kind = 'paragraph'").select("doc_id", F.explode("path").alias("node"), "lo", "hi")
    return leaves.groupBy("doc_id", "node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("leaves"))


def slides_tree(blocks: DataFrame) -> DataFrame:
    """doc_id, section, title, body, n: each title opens a section; what stands before the first is left out."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumn("section", F.sum((F.col("kind") == "heading").cast("long")).over(w)).where("section > 0")
    text = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "text")))), lambda s: s["text"]), "\n")
    return rows.groupBy("doc_id", "section").agg(text(F.col("kind") == "heading").alias("title"), text(F.col("kind") != "heading").alias("body"), F.count("*").alias("n"))


def size_levels(headings: DataFrame) -> DataFrame:
    """`headings(doc_id, size)` with level: the three largest sizes (to one decimal) are levels 1 to 3, others null."""
    sizes = headings.select("doc_id", F.round("size", 1).alias("size1")).distinct()
    ranked = sizes.withColumn("level", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size1")))).where("level <= 3")
    return headings.withColumn("size1", F.round("size", 1)).join(ranked, ["doc_id", "size1"], "left").drop("size1")


def numbered(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id", order: str = "child_ord") -> DataFrame:
    """`nodes` (with path from below the root to the node) and number, like 1.1.I.a."""
    w = Window.partitionBy("doc_id", parent).orderBy(order)
    own = nodes.withColumn("_n", F.row_number().over(w))
    steps = own.select("doc_id", node, F.posexplode("path").alias("_d", "_at"))
    names = own.select("doc_id", F.col(node).alias("_at"), "_n")
    named = steps.join(names, ["doc_id", "_at"]).groupBy("doc_id", node).agg(F.array_sort(F.collect_list(F.struct("_d", format_level(F.col("_n"), F.col("_d") + 1).alias("s")))).alias("_s"))
    return nodes.join(named.select("doc_id", node, F.array_join(F.col("_s.s"), ".").alias("number")), ["doc_id", node])


def descendants(nodes: DataFrame) -> DataFrame:
    """doc_id, ancestor and node_id for every node and each node on its path, itself included."""
    return nodes.select("doc_id", "node_id", F.explode("path").alias("ancestor"), "kind", "text")


def rollup(nodes: DataFrame) -> DataFrame:
    """For each node, over its subtree: leaves, characters of stripped leaf texts, nodes and depth below."""
    rows = nodes.select("doc_id", "node_id", "kind", "text", F.size("path").alias("depth"), F.posexplode("path").alias("at", "ancestor"))
    leaf = F.col("kind") == "paragraph"
    return rows.groupBy("doc_id", "ancestor").agg(F.count_if(leaf).alias("leaves"), F.sum(F.when(leaf, F.length(stripped(F.col("text")))).otherwise(0)).cast("long").alias("chars"), F.count("*").alias("nodes"), F.max(F.col("depth") - F.col("at") - 1).cast("int").alias("depth"))


def collected_text(nodes: DataFrame, order: str = "sort_key") -> DataFrame:
    """For each node the texts of the leaves below it, in document order, with blank lines between."""
    rows = nodes.where((F.col("kind") == "paragraph") & (stripped(F.col("text")) != "")).select("doc_id", F.explode("path").alias("node_id"), order, "text")
    return rows.groupBy("doc_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]), "\n\n").alias("text"))


def pruned(nodes: DataFrame) -> DataFrame:
    """Without blank leaves and inner nodes that are left without any leaf."""
    full = nodes.where((F.col("kind") == "paragraph") & (stripped(F.col("text")) != ""))
    kept = full.select("doc_id", F.explode("path").alias("node_id")).distinct()
    return nodes.join(kept, ["doc_id", "node_id"], "left_semi")


def issues(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, issue: leaves without text, inner nodes with text, roots below the top, kinds without children."""
    parents = nodes.select("doc_id", F.col("parent_id").alias("node_id")).where("node_id is not null").distinct().withColumn("inner", F.lit(True))
    rows = nodes.join(parents, ["doc_id", "node_id"], "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
    blank = F.coalesce(stripped(F.col("text")) == "", F.lit(True))
    found = F.filter(F.array(F.when(~F.col("inner") & (F.col("kind") != "paragraph"), "leaf isn't a paragraph"), F.when(~F.col("inner") & blank, "leaf without text"), F.when(F.col("inner") & ~blank, "inner node with text"), F.when((F.col("kind") == "root") & (F.size("path") > 1), "root below the top")), lambda x: x.isNotNull())
    return rows.select("doc_id", "node_id", F.explode(found).alias("issue"))


def needless(nodes: DataFrame) -> DataFrame:
    """doc_id and node_id of inner nodes whose only child is an inner node, but for roots; a written table."""
    child = nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"), F.min("kind").alias("only"))
    child = child.where("n = 1 and only <> 'paragraph'").select("doc_id", "node_id")
    return stored(nodes.where("parent_id is not null").select("doc_id", "node_id").join(child, ["doc_id", "node_id"]), "needless")


def shortened(nodes: DataFrame, *others: str) -> DataFrame:
    """doc_id, node_id, `others` and path of `nodes` without the needless ones, which go from the paths too.

    Only steps of paths, without texts, are shuffled, and of documents with a needless node; paths without one stay as they are.
    """
    gone = needless(nodes)
    rows = nodes.select("doc_id", "node_id", *others, "path")
    if gone.isEmpty():
        return rows
    kept = rows.join(gone, ["doc_id", "node_id"], "left_anti")
    some = gone.select("doc_id").distinct()
    whole = kept.join(some, "doc_id", "left_anti")
    steps = kept.join(some, "doc_id", "left_semi").select("doc_id", "node_id", F.posexplode("path").alias("at", "up"))
    hit = steps.join(gone.withColumnRenamed("node_id", "up"), ["doc_id", "up"]).groupBy("doc_id", "node_id").agg(F.collect_set("up").alias("out"))
    cut = kept.join(some, "doc_id", "left_semi").join(hit, ["doc_id", "node_id"], "left")
    path = F.when(F.col("out").isNull(), F.col("path")).otherwise(F.filter("path", lambda x: ~F.array_contains("out", x)))
    return whole.unionByName(cut.withColumn("path", path).drop("out"))


def collapsed(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, parent_id, level: without inner nodes whose only child is an inner node; the root stays."""
    up = F.size("path") - 1
    return shortened(nodes).select("doc_id", "node_id", F.when(up > 0, F.element_at("path", F.greatest(up, F.lit(1)))).alias("parent_id"), up.cast("int").alias("level"))


def flattened(nodes: DataFrame, most: int = 4) -> DataFrame:
    """doc_id, node_id, parent_id, level: inner nodes below depth `most` go, and their leaves hang at that depth's node."""
    depth = F.size("path") - 1
    kept = nodes.where((depth <= most) | (F.col("kind") == "paragraph"))
    deep = depth > most
    return kept.select("doc_id", "node_id", F.when(deep, F.get("path", F.lit(most))).otherwise(F.col("parent_id")).alias("parent_id"), F.least(depth, F.lit(most + 1)).cast("int").alias("level"))


def rehung(kept: DataFrame) -> DataFrame:
    """`kept(doc_id, node_id, kind, path)`, with label and text where given, with the parents and levels that the paths say."""
    up = F.size("path") - 1
    return kept.select("doc_id", "node_id", F.when(up > 0, F.element_at("path", F.greatest(up, F.lit(1)))).alias("parent_id"), up.cast("int").alias("level"), "kind", *(c for c in ("label", "text") if c in kept.columns), "path")


def decided_depth(nodes: DataFrame, most: int = 4) -> DataFrame:
    """Trees with single-child chains collapsed, levels anew, and flattened to `most` where deeper; `warning` says so."""
    short = shortened(nodes, "kind", *(c for c in ("label", "text") if c in nodes.columns))
    depth = short.groupBy("doc_id").agg((F.max(F.size("path")) - 1).alias("depth"))
    rows = short.join(depth, "doc_id")
    deep, inner = F.size("path") - 1 > most, F.col("kind") != "paragraph"
    cut = F.when(deep, F.concat(F.slice("path", 1, most + 1), F.array("node_id"))).otherwise(F.col("path"))
    # a leaf below the deepest level hangs there; an inner node there goes
    flat = rows.where(~(deep & inner)).withColumn("path", cut)
    said = F.format_string("natural depth %s exceeded max (%s); flattened", "depth", F.lit(most))
    warned = depth.where(F.col("depth") > most).select("doc_id", said.alias("warning"))
    return rehung(flat).join(warned, "doc_id", "left")


def undominated(selection: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the selected nodes, once each, those without a selected ancestor."""
    picked = selection.select("doc_id", "node_id").distinct()
    above = nodes.join(picked, ["doc_id", "node_id"], "left_semi").select("doc_id", "node_id", F.explode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("up"))
    covered = above.join(picked.withColumnRenamed("node_id", "up"), ["doc_id", "up"], "left_semi").select("doc_id", "node_id")
    return picked.join(nodes, ["doc_id", "node_id"], "left_semi").join(covered, ["doc_id", "node_id"], "left_anti")


def tri_state(selection: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each node, how much of its subtree is selected: checked, indeterminate or unchecked."""
    mark = selection.select("doc_id", "node_id").distinct().withColumn("sel", F.lit(1))
    rows = descendants(nodes).join(mark, ["doc_id", "node_id"], "left").groupBy("doc_id", F.col("ancestor").alias("node_id")).agg(F.count("sel").alias("picked"), F.count("*").alias("size"))
    return rows.withColumn("state", F.when(F.col("picked") == F.col("size"), "checked").when(F.col("picked") > 0, "indeterminate").otherwise("unchecked"))


def references(nodes: DataFrame) -> DataFrame:
    """Chapters and sections under an unbroken line of such (below the root) as ref_id, level, label and parent's label."""
    blocked = nodes.where(~F.col("kind").isin("root", "chapter", "section")).select("doc_id", F.col("node_id").alias("up")).distinct()
    rows = nodes.where(F.col("kind").isin("chapter", "section"))
    bad = rows.select("doc_id", "node_id", F.explode("path").alias("up")).join(blocked, ["doc_id", "up"], "left_semi").select("doc_id", "node_id").distinct()
    parent = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("label").alias("parent_label"))
    good = rows.join(bad, ["doc_id", "node_id"], "left_anti").join(parent, ["doc_id", "parent_id"], "left")
    return good.select(F.concat("doc_id", F.lit("::"), "node_id").alias("ref_id"), "doc_id", "node_id", "kind", "label", "parent_label", "sort_key")


def ranked(rows: DataFrame, order: str, name: str) -> DataFrame:
    """`rows` with their rank from 1 on: counted within ranges of the order, and added to the counts of the ranges before."""
    # the rows have to stay where they are between the two uses
    dealt = rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()).persist()
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_size"))  # a row for each partition
    start = counts.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.withColumn("_within", within).join(F.broadcast(start), "_part").withColumn(name, F.col("_within") + F.col("_before")).drop("_part", "_within", "_before")


def aggregate_fallback(refs: DataFrame) -> DataFrame:
    """References grouped by source: node_id agg_i_j in order of the sources' first reference, and the category's label."""
    first = refs.groupBy("source_filename").agg(F.min("ord").alias("first"), F.count("*").alias("n_refs"))
    ranks = ranked(first, "first", "i")
    rows = refs.join(ranks, "source_filename").withColumn("j", F.row_number().over(Window.partitionBy("source_filename").orderBy("ord")))
    return rows.select(F.concat(F.lit("agg_"), "i", F.lit("_"), "j").alias("node_id"), F.regexp_replace("source_filename", r"\.[^.]*$", "").alias("category"), "ref_id", "n_refs")


def placed(refs: DataFrame, response: DataFrame) -> DataFrame:
    """Where a response's tree puts each reference: known references at their first place, missing ones under the catch-all."""
    w = Window.partitionBy("ref_id").orderBy("pos")
    known = response.join(refs.select("ref_id"), "ref_id", "left_semi").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("ref_id", "category")
    missing = refs.join(known, "ref_id", "left_anti").select("ref_id", F.lit("Senza categoria").alias("category"))
    return known.unionByName(missing)


def next_prefix(ids: DataFrame) -> Column | int:
    """The number of the next merge: one more than the largest s<N>_ head among the ids."""
    n = F.expr("try_cast(regexp_extract(node_id, '^s([0-9]+)_', 1) as int)")
    return int(ids.agg(F.coalesce(F.max(n), F.lit(0)).alias("n")).first().n) + 1


def merged(old: DataFrame, new: DataFrame, label: str) -> DataFrame:
    """node_id, parent_id, level, kind, label of the old tree with the new one's nodes, prefixed, under a chapter of its own."""
    prefix = f"s{next_prefix(old)}_"
    tops = [rows.where("parent_id is null").select("node_id").first() for rows in (old, new)]
    if None in tops:
        raise ValueError("a tree without a root can't be merged")
    root, top = (t.node_id for t in tops)
    same = old.select("node_id", "parent_id", "level", "kind", "label")
    rest = new.where("parent_id is not null").select(F.concat(F.lit(prefix), "node_id").alias("node_id"), F.when(F.col("parent_id") == top, F.lit(prefix + "root")).otherwise(F.concat(F.lit(prefix), "parent_id")).alias("parent_id"), (F.col("level") + 1).alias("level"), "kind", "label")
    wrap = old.where("parent_id is null").select(F.lit(prefix + "root").alias("node_id"), F.lit(root).alias("parent_id"), F.lit(1).alias("level"), F.lit("chapter").alias("kind"), F.lit(label).alias("label"))
    return same.unionByName(rest).unionByName(wrap)


def valid_ranges(ranges: DataFrame, items: DataFrame) -> DataFrame:
    """Ranges(doc_id, pos, start_id, end_id) whose ends are items in order; for docs without any, one range per item."""
    start = items.select("doc_id", F.col("item_id").alias("start_id"), F.col("ord").alias("lo"))
    end = items.select("doc_id", F.col("item_id").alias("end_id"), F.col("ord").alias("hi"))
    good = ranges.join(start, ["doc_id", "start_id"]).join(end, ["doc_id", "end_id"]).where("lo <= hi").select("doc_id", "pos", "lo", "hi")
    alone = items.join(good.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.col("ord").alias("pos"), F.col("ord").alias("lo"), F.col("ord").alias("hi"))
    return good.unionByName(alone)


def segmented(ranges: DataFrame) -> DataFrame:
    """Of valid ranges with one start, the first; in order."""
    w = Window.partitionBy("doc_id", "lo").orderBy("pos")
    return ranges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def uncovered(ranges: DataFrame) -> DataFrame:
    """Valid ranges that begin after all kept before them: an ordered fold over each document's few ranges."""
    ordered = ranges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("lo", "pos", "hi"))).alias("r"))
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.slice("r", 1, 0).alias("kept"))
    fold = F.aggregate("r", start, lambda acc, x: F.when(x["lo"] > acc["end"], F.struct(x["hi"].cast("long").alias("end"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc))
    return ordered.select("doc_id", F.explode(fold["kept"]).alias("x")).select("doc_id", "x.lo", "x.hi")


def sections(items: DataFrame, ranges: DataFrame, failed: DataFrame, most: int) -> DataFrame:
    """doc_id, lo, hi of the groups that a response gives: its valid ranges, one per item if it has none.

    Documents in `failed` (the call gave nothing) have one group up to `most` items, else chunks of n // most; a single item is a group.
    """
    lone = items.groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 1").select("doc_id")
    plain = failed.select("doc_id").distinct().join(lone, "doc_id", "left_anti")
    chunks = fallback_chunks(items.join(plain, "doc_id", "left_semi"), "doc_id", "ord", most).groupBy("doc_id", "chunk").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).select("doc_id", "lo", "hi")
    asked = items.join(plain, "doc_id", "left_anti")
    given = ranges.join(plain, "doc_id", "left_anti")
    return uncovered(valid_ranges(given, asked)).unionByName(chunks)


def two_passes(items: DataFrame, ranges: DataFrame, failed: DataFrame, chapters: DataFrame, chapters_failed: DataFrame, most: int = 12, most_sections: int = 8) -> DataFrame:
    """doc_id, item_id, section, chapter (null up to `most_sections` sections) and level of every item in a group.

    `chapters(doc_id, pos, start_id, end_id)` is the second response, over the sections' numbers from 1 on as texts.
    """
    first = sections(items, ranges, failed, most)
    first = stored(first.withColumn("section", F.row_number().over(Window.partitionBy("doc_id").orderBy("lo")).cast("long")), "sections")
    many = first.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > most_sections).select("doc_id")
    units = first.join(many, "doc_id", "left_semi").select("doc_id", F.col("section").cast("string").alias("item_id"), F.col("section").alias("ord"))
    second = sections(units, chapters, chapters_failed.join(many, "doc_id", "left_semi"), most_sections)
    second = second.withColumn("chapter", F.row_number().over(Window.partitionBy("doc_id").orderBy("lo")).cast("long"))
    of = members(second.select("doc_id", "lo", "hi", "chapter"), units).select("doc_id", F.col("ord").alias("section"), "chapter")
    own = members(first, items).select("doc_id", "item_id", "section")
    level = F.when(F.col("chapter").isNull(), 2).otherwise(3)
    # a section that no chapter takes goes with its items
    kept = own.join(many.withColumn("many", F.lit(True)), "doc_id", "left").join(of, ["doc_id", "section"], "left").where("many is null or chapter is not null")
    return kept.select("doc_id", "item_id", "section", "chapter", level.alias("level"))


def members(ranges: DataFrame, items: DataFrame) -> DataFrame:
    """Items of each range: an interval join within the document."""
    r = ranges.withColumnRenamed("doc_id", "d")
    return items.join(r, (F.col("doc_id") == F.col("d")) & F.col("ord").between(F.col("lo"), F.col("hi"))).drop("d")


def children(nodes: DataFrame) -> DataFrame:
    """Each node that has a parent, with the parent's kind and label."""
    parents = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"), F.col("label").alias("parent_label"))
    return nodes.select("doc_id", "node_id", "parent_id", "child_ord").join(parents, ["doc_id", "parent_id"])


def current_heading(views: DataFrame, headings: DataFrame, margin: int = 80) -> DataFrame:
    """Each of views(doc_id, view_id, y) with the last of headings(doc_id, heading_id, top) down to y + margin, or the first.

    A heading holds from its top to the next one's, so that each view meets one range of its document.
    """
    w = Window.partitionBy("doc_id").orderBy("top", "heading_id")
    spans = headings.select("doc_id", "heading_id", F.when(F.row_number().over(w) > 1, F.col("top")).alias("lo"), F.lead("top").over(w).alias("hi"))
    at = F.col("y") + margin
    inside = (F.col("lo").isNull() | (at >= F.col("lo"))) & (F.col("hi").isNull() | (at < F.col("hi")))
    return views.join(spans.withColumnRenamed("doc_id", "_doc"), (F.col("doc_id") == F.col("_doc")) & inside).select("doc_id", "view_id", "heading_id")
