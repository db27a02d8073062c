"""Ancestors of nodes that know only their parent, and what follows from them.

Lines up are first followed within pieces of the rows as they lie, as parents mostly lie near their children; where a line leaves its piece, or
gets longer than LONGEST, it ends with a pointer to a node elsewhere. Of these targets, each once, the rest of the line is found by pointer
doubling: each round joins every open target to the one it points at and takes over its pointer, so a line of d targets takes log2(d)
rounds; each round is a written table. A round that closes no target proves that the rest never reach a root: they lie in a cycle or below
one, and are told so instead of being followed. That is found out by the pointers alone, before paths are put together, as a cycle's would double
in every round. Only open targets take part in the next round; a target of many lines is one row against many, which Spark's skew handling splits.

Pairs that come with their nodes meet within a piece where both lie in it below one top; neither their paths nor other nodes' move. Only for the
rest are paths made, in a second pass, and of the nodes that a filter of bounded size lets through: those asked for, the targets, and few others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Rows of a piece, and nodes of a line within one at most.
PIECE, LONGEST = 1 << 16, 32
#: Hashes packed at once, and cells they are dealt to; bits of a filter at most (64 MB; beyond some 45 million nodes it has less than 12 for each), its slices and probes.
PACK, CELLS, BITS, SLICES, PROBES = 1 << 20, 256, 1 << 29, 64, 4


def paths(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, path (from the top to the node) and fault of `nodes(doc_id, node_id, parent_id)`.

    fault: `orphan` where the line up ends at a parent that isn't there (the path begins below it), `cycle` where it never ends (no
    path), else null. Of rows that repeat a node's id, the one with the smallest parent counts; null ids are left out.
    `nodes` is read twice, so it should be a written table.
    """
    near = stored(followed(once(nodes, repeated(nodes))), "paths-near", "zstd")
    targets = stored(near.where("to is not null").select("doc_id", F.col("to").alias("node_id")).distinct(), "paths-targets")
    return near.drop("to") if targets.isEmpty() else completed(near, ends(near, targets))


def ends(near: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, node_id, path and fault of all `targets(doc_id, node_id)` that lines of `near` (as of `followed`) point at."""
    there = stored(near.join(targets, ["doc_id", "node_id"]).withColumn("there", F.lit(True)), "paths-there")
    lines = targets.join(there, ["doc_id", "node_id"], "left").withColumn("fault", F.when(F.col("there").isNull(), "orphan").otherwise(F.col("fault")))
    lines = stored(lines.select("doc_id", "node_id", "to", F.when(F.col("there").isNull(), F.array().cast("array<string>")).otherwise(F.col("path")).alias("path"), "fault"), "paths-lines")
    return stored(resolved(lines), "paths-ends")


def completed(near: DataFrame, ends: DataFrame) -> DataFrame:
    """doc_id, node_id, path and fault: the lines of `near` with those of the nodes elsewhere that they point at."""
    end = ends.select("doc_id", F.col("node_id").alias("to"), F.col("path").alias("up"), F.col("fault").alias("end"))
    far = near.where("to is not null").drop("fault").join(end, ["doc_id", "to"])  # without the targets' path (a cycle) there is none
    return near.where("to is null").drop("to").unionByName(far.select("doc_id", "node_id", F.concat("up", "path").alias("path"), F.col("end").alias("fault")))


def once(nodes: DataFrame, often: DataFrame | None, *kept: str) -> DataFrame:
    """Each node once, with its smallest parent; `kept` columns are null where its rows were many. Only rows that `often` names are shuffled, others stay as they lie."""
    rows = nodes.where("node_id is not null").select("doc_id", "node_id", "parent_id", *kept)
    if often is None:
        return rows
    rows = rows.withColumn("own", own48())
    least = rows.join(often, "own", "left_semi").groupBy("doc_id", "node_id").agg(F.min(F.struct(F.col("parent_id").isNotNull().alias("has"), "parent_id")).alias("p"))
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in kept]
    return rows.join(often, "own", "left_anti").drop("own").unionByName(least.select("doc_id", "node_id", "p.parent_id", *none))


def repeated(nodes: DataFrame) -> DataFrame | None:
    """own (as of `own48`) of the nodes that have several rows, and of a few others by chance; None if there are none.

    Hashes are dealt in sorted packs, as the gaps between them: some 4 bytes a row, where a grouping by hash shuffles 13.
    """
    packs = nodes.where("node_id is not null").select(own48().alias("own")).mapInArrow(packed, "cell int, least long, width int, gaps binary")
    often = stored(packs.groupBy("cell").applyInArrow(twice, "own long"), "paths-often")
    return None if often.isEmpty() else often


def own48() -> Column:
    """48 bits of a node's hash."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", "node_id"), 16)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of hashes by cell (their first 8 bits of 48): the least, and the gaps to the next ones in `width` bytes each."""
    for rows in gathered(batches, PACK):
        own = np.sort(rows.column(0).to_numpy())
        bounds = np.searchsorted(own >> 40, np.arange(CELLS + 1))
        out = []
        for cell in np.flatnonzero(np.diff(bounds)).tolist():
            part = own[bounds[cell] : bounds[cell + 1]]
            gaps = np.diff(part).astype("<i8")
            width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
            out.append((cell, int(part[0]), width, gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["cell", "least", "width", "gaps"])


def twice(packs: pa.Table) -> pa.Table:
    """The hashes that come more than once in a cell's packs."""
    parts = []
    for least, width, gaps in zip(*(packs.column(c).to_pylist() for c in ("least", "width", "gaps"))):
        wide = np.zeros((len(gaps) // width + 1, 8), np.uint8)
        wide[1:, :width] = np.frombuffer(gaps, np.uint8).reshape(-1, width)
        parts.append(np.cumsum(wide.view("<i8")[:, 0]) + least)
    own = np.sort(np.concatenate(parts))
    return pa.table({"own": pa.array(np.unique(own[1:][own[1:] == own[:-1]]), pa.int64())})


def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of `least` rows or a batch more; the last may have fewer, none is empty."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            yield pa.Table.from_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def followed(rows: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, node_id, path, to and fault: lines up within pieces of PIECE rows, and the node elsewhere that a line's top points at.

    With `wanted(doc_id, node_id)` only these nodes' lines, and some others'.
    """
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    shared = None
    if wanted is not None:
        shared = rows.sparkSession.sparkContext.broadcast(sieve(wanted))
        rows = rows.withColumn("own", F.xxhash64("doc_id", "node_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, PIECE):
            chosen = None if shared is None else np.flatnonzero(passing(part.column("own").to_numpy(), shared.value))
            yield from piece(part, chosen).to_batches()

    return rows.mapInArrow(run, f"doc_id {kind['doc_id']}, node_id {kind['node_id']}, path array<{kind['node_id']}>, to {kind['parent_id']}, fault string")


def places(rows: pa.Table, *columns: str) -> list[np.ndarray]:
    """For each of the columns, the rows of the nodes that it names; as many as there are rows where it names none here."""
    # a text's number ends before the first NUL, so that no two keys are alike; keys with a null are null, and stand nowhere
    doc = pc.cast(pc.dictionary_encode(rows.column("doc_id").combine_chunks()).indices, pa.string())
    own, *named = (pc.binary_join_element_wise(doc, pc.cast(rows.column(c).combine_chunks(), pa.string()), "\0") for c in ("node_id", *columns))
    return [np.array(pc.fill_null(pc.index_in(x, own, skip_nulls=True), rows.num_rows).to_numpy(zero_copy_only=False), np.int64) for x in named]


def climbed(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The depth below the top of its line, and whether it never ends, of each row with its parent's row (as many as rows: none)."""
    n = len(parent)
    up = np.append(parent, n)
    depth = (up < n).astype(np.int64)
    for _ in range(n.bit_length()):
        depth, up = depth + depth[up], up[up]
    return depth[:n], up[:n] < n


def piece(rows: pa.Table, chosen: np.ndarray | None = None) -> pa.Table:
    """`followed` of one piece; of the chosen rows, if given."""
    rows = rows.combine_chunks()
    n = rows.num_rows
    (parent,) = places(rows, "parent_id")
    depth, cycle = climbed(parent)
    parent[cycle | (depth % LONGEST == 0)] = n
    chosen = np.arange(n) if chosen is None else chosen
    cycle = cycle[chosen]
    size = np.where(cycle, 0, depth[chosen] % LONGEST + 1)
    bounds = np.concatenate([[0], np.cumsum(size)])
    flat, top = np.empty(bounds[-1], np.int64), chosen.copy()
    line = np.flatnonzero(~cycle)
    at, slot = chosen[line], bounds[1:][line] - 1
    while len(line):
        flat[slot], top[line] = at, at
        at = parent[at]
        on = at < n
        line, at, slot = line[on], at[on], slot[on] - 1
    astray = (np.asarray(rows.column("doc_id").is_null()) & np.asarray(rows.column("parent_id").is_valid()))[chosen]  # without a doc_id, no parent is found
    ids, to = rows.column("node_id").combine_chunks(), rows.column("parent_id").combine_chunks().take(pa.array(top, mask=cycle | astray))
    path = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), ids.take(pa.array(flat)), mask=pa.array(cycle))
    return pa.table([rows.column("doc_id").take(pa.array(chosen)), ids.take(pa.array(chosen)), path, to, pa.array(np.where(cycle, "cycle", np.where(astray, "orphan", None)), pa.string())], ["doc_id", "node_id", "path", "to", "fault"])


def sieve(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of `wanted(doc_id, node_id)`, SLICES x bytes: 12 to 24 bits a node, as far as BITS goes."""
    bits = min(BITS, max(1 << 16, 1 << (12 * wanted.count()).bit_length())) // SLICES

    def cut(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        seen = np.zeros(bits, bool)
        for at in probes(rows.column("own").to_numpy().view(np.uint64), bits):
            seen[at] = True
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(seen, bitorder="little").tobytes()], pa.binary())})

    own = wanted.select(F.xxhash64("doc_id", "node_id").alias("own")).distinct()
    out = np.zeros((SLICES, bits // 8), np.uint8)
    for row in own.groupBy(F.shiftrightunsigned("own", 58).alias("slice")).applyInArrow(cut, "slice long, bits binary").collect():
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out


def probes(own: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits of each hash within its slice, which its first 6 bits tell."""
    step = (own >> np.uint64(26) & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    for i in range(PROBES):
        yield ((own & np.uint64(0xFFFFFFFF)) + np.uint64(i) * step & np.uint64(bits - 1)).astype(np.int64)


def passing(own: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the filter lets each hash through."""
    own = own.view(np.uint64)
    at, out = (own >> np.uint64(58)).astype(np.int64), np.ones(len(own), bool)
    for p in probes(own, bits.shape[1] * 8):
        out &= (bits[at, p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return out


def resolved(lines: DataFrame) -> DataFrame:
    """doc_id, node_id, path and fault of `lines(doc_id, node_id, to, path, fault)` followed from `to` to `to` until it is null."""
    if lines.where("to is not null").isEmpty():
        return lines.drop("to")
    _, endless = doubled(lines.withColumn("path", F.when(F.col("path").isNotNull(), F.array().cast("array<string>"))))
    parts, _ = doubled(lines.join(endless, ["doc_id", "node_id"], "left_anti"))
    out = endless.select("doc_id", "node_id", F.lit(None).cast("array<string>").alias("path"), F.lit("cycle").alias("fault"))
    for part in parts:
        out = out.unionByName(part)
    return out


def doubled(lines: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The lines that end (doc_id, node_id, path, fault), by rounds, and the ids of those that don't."""
    parts, open_ = [lines.where("to is null").select("doc_id", "node_id", "path", "fault")], lines.where("to is not null").select("doc_id", "node_id", "to", "path")
    left = open_.count()
    while left:
        above = open_.select("doc_id", F.col("node_id").alias("to"), F.col("to").alias("next"), F.col("path").alias("up"), F.lit(None).cast("string").alias("fault"))
        for part in parts:
            above = above.unionByName(part.select("doc_id", F.col("node_id").alias("to"), F.lit(None).alias("next"), F.col("path").alias("up"), "fault"))
        step = open_.join(above, ["doc_id", "to"]).select("doc_id", "node_id", F.col("next").alias("to"), F.concat("up", "path").alias("path"), "fault")
        step = stored(step, "paths-step", "zstd")
        parts.append(step.where("to is null").select("doc_id", "node_id", "path", "fault"))
        open_ = step.where("to is not null").select("doc_id", "node_id", "to", "path")
        now = open_.count()
        if now == left:
            break
        left = now
    return parts, open_.select("doc_id", "node_id")


def breadcrumbs(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, node_id, labels (of the path's labelled nodes but the root) and section (the nearest on it that is no paragraph or root).

    `nodes(doc_id, node_id, kind, label)`; `found` as of `paths`. A node's crumbs are its parent's and its own, so only the paths of nodes that
    have children are taken apart: a row for each of these and each of its ancestors that has a label or is a section.
    """
    label, kind = F.trim("label"), F.col("kind")
    marks = nodes.select("doc_id", "node_id", F.when((kind != "root") & (label != ""), label).alias("label"), (~kind.isin("paragraph", "root")).alias("is_section"))
    own = marks.where("label is not null or is_section").groupBy("doc_id", "node_id").agg(F.sort_array(F.collect_list("label")).alias("own"), F.bool_or("is_section").alias("is_section"))
    lines = stored(found.where("path is not null").select("doc_id", "node_id", F.slice("path", 1, F.size("path") - 1).alias("up")), "crumbs-lines", "zstd")

    steps = lines.where("size(up) > 0").select("doc_id", "up").distinct().select("doc_id", F.element_at("up", -1).alias("parent"), F.posexplode("up").alias("place", "node_id"))
    section = F.max_by(F.when(F.col("is_section"), F.col("node_id")), F.when(F.col("is_section"), F.col("place"))).alias("section")
    above = steps.join(own, ["doc_id", "node_id"]).groupBy("doc_id", "parent").agg(F.array_sort(F.collect_list(F.struct("place", "own"))).alias("each"), section)
    above = above.select("doc_id", "parent", F.flatten(F.transform("each", lambda x: x["own"])).alias("labels"), "section")

    each = lines.select("doc_id", "node_id", F.try_element_at("up", F.lit(-1)).alias("parent")).join(own, ["doc_id", "node_id"], "left").join(above, ["doc_id", "parent"], "left")
    none = F.array().cast("array<string>")
    return each.select("doc_id", "node_id", F.concat(F.coalesce("labels", none), F.coalesce("own", none)).alias("labels"), F.when(F.col("is_section"), F.col("node_id")).otherwise(F.col("section")).alias("section"))


def lowest_common(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """`pairs(doc_id, a, b)` with their lowest common ancestor (either may be it) and the steps between them; null in different trees.

    `found` as of `paths`; all its paths move. Where the pairs come with their nodes, `lowest_common_beside` moves few.
    """
    ends = pairs.select("doc_id", F.explode(F.array("a", "b")).alias("node_id")).distinct()
    return compared(pairs, stored(found.select("doc_id", "node_id", "path").join(ends, ["doc_id", "node_id"], "left_semi"), "paths-asked", "zstd"))


def compared(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """`lowest_common` by the paths' common beginnings. `asked(doc_id, node_id, path)` is read twice, so it should be a written table."""
    side = lambda c: asked.select("doc_id", F.col("node_id").alias(c), F.col("path").alias("path_" + c))
    rows = pairs.join(side("a"), ["doc_id", "a"], "left").join(side("b"), ["doc_id", "b"], "left")
    shared = F.aggregate(F.arrays_zip("path_a", "path_b"), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & F.coalesce(x["path_a"] == x["path_b"], F.lit(False))).cast("int")).alias("n"), (s["on"] & F.coalesce(x["path_a"] == x["path_b"], F.lit(False))).alias("on")), lambda s: s["n"])
    rows = rows.withColumn("shared", F.when(F.get("path_a", F.lit(0)) == F.get("path_b", F.lit(0)), shared))  # no more where the tops differ
    ancestor = F.when(F.col("shared") > 0, F.try_element_at("path_a", F.col("shared")))
    return rows.select("doc_id", "a", "b", ancestor.alias("ancestor"), F.when(F.col("shared") > 0, F.size("path_a") + F.size("path_b") - 2 * F.col("shared")).alias("steps"))


def lowest_common_beside(nodes: DataFrame) -> DataFrame:
    """`lowest_common` for `nodes(doc_id, node_id, parent_id, other, paired)`: a pair of node_id and other for each row that is `paired`.

    Nodes as for `paths`. `nodes` is read a few times, so it should be a written table.
    """
    often = repeated(nodes)
    found = stored(met(once(nodes, often, "other", "paired")), "pairs-near", "zstd")
    apart = nodes.where("paired and node_id is null").drop("parent_id")
    if often is not None:  # the pairs of repeated nodes' rows are all kept
        apart = apart.unionByName(nodes.where("paired and node_id is not null").withColumn("own", own48()).join(often, "own", "left_semi").drop("own", "parent_id"))
    far = found.where("kind = 'far'").select("doc_id", "a", "b").unionByName(apart.select("doc_id", F.col("node_id").alias("a"), F.col("other").alias("b")))
    done, open_ = (found.where(F.col("kind") == kind) for kind in ("done", "open"))
    targets = stored(found.where("kind = 'target'").select("doc_id", F.col("to").alias("node_id")).distinct(), "paths-targets")
    wanted = targets.unionByName(far.select("doc_id", F.explode(F.array("a", "b")).alias("node_id")))
    out = ["doc_id", "a", "b", "ancestor", "steps"]
    if wanted.isEmpty():
        return done.select(*out)  # open pairs have a target
    asked, targets = closed(once(nodes, often), stored(followed(once(nodes, often), wanted), "paths-near", "zstd"), targets)
    tops = ends(asked, targets)
    endless = tops.where("fault = 'cycle'").select("doc_id", F.col("node_id").alias("to"), F.lit(True).alias("never"))
    if not endless.isEmpty():
        known = F.col("never").isNull()
        open_ = open_.join(endless, ["doc_id", "to"], "left").withColumns({c: F.when(known, F.col(c)) for c in out[3:]})
    return done.select(*out).unionByName(open_.select(*out)).unionByName(compared(far, stored(completed(asked, tops).drop("fault"), "paths-asked", "zstd")))


def closed(rows: DataFrame, near: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`near` with the lines of all targets, and all targets: those given, and any that lines of `near` point at besides.

    There are such only if `rows` were cut into other pieces than when the targets were told, as Spark may where its cores change or rows were shuffled.
    """
    while True:
        missing = near.where("to is not null").select("doc_id", F.col("to").alias("node_id")).distinct().join(targets, ["doc_id", "node_id"], "left_anti")
        missing = stored(missing, "paths-missing")
        if missing.isEmpty():
            return near, targets
        more = followed(rows, missing).join(missing, ["doc_id", "node_id"], "left_semi").join(near.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")
        near, targets = near.unionByName(stored(more, "paths-more", "zstd")), targets.unionByName(missing)


def met(rows: DataFrame) -> DataFrame:
    """doc_id, a, b, ancestor, steps, to and kind, of the pairs that come with `rows`, and the nodes elsewhere that `followed` lines point at (kind: `target`, in `to`).

    kind of a pair: `done`; `open`, where both lie below `to`, and have no ancestor if its line never ends; else `far`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, PIECE):
            yield from meetings(part).to_batches()

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"doc_id {kind['doc_id']}, a {kind['node_id']}, b {kind['other']}, ancestor {kind['node_id']}, steps int, to {kind['parent_id']}, kind string")


def meetings(rows: pa.Table) -> pa.Table:
    """`met` of one piece."""
    names = ["doc_id", "a", "b", "ancestor", "steps", "to", "kind"]
    rows = rows.combine_chunks()
    n = rows.num_rows
    parent, other = places(rows, "parent_id", "other")
    depth, cycle = climbed(parent)
    parent[cycle] = n
    ups = [np.append(parent, n)]
    while (ups[-1] < n).any():
        ups.append(ups[-1][ups[-1]])
    top = np.append(np.where(parent < n, parent, np.arange(n)), n)
    for _ in ups:
        top = top[top]
    doc, ids, above = (rows.column(c).combine_chunks() for c in ("doc_id", "node_id", "parent_id"))
    known, leads = np.asarray(doc.is_valid()), np.append(np.asarray(above.is_valid()), True)
    depth, cycle = np.append(depth, 0), np.append(cycle, False)

    a = np.flatnonzero(np.asarray(pc.fill_null(rows.column("paired").combine_chunks(), False)))
    b = other[a]
    never = cycle[a] | cycle[b] | ~known[a]
    one = ~never & (b < n) & (top[a] == top[b])
    x, y = np.where(one, a, n), np.where(one, b, n)
    gap = depth[x] - depth[y]
    x, y, gap = np.where(gap < 0, y, x), np.where(gap < 0, x, y), np.abs(gap)
    for j, up in enumerate(ups):
        x = np.where(gap >> j & 1, up[x], x)
    for up in reversed(ups):
        differ = up[x] != up[y]
        x, y = np.where(differ, up[x], x), np.where(differ, up[y], y)
    at = np.where(x == y, x, ups[0][x])
    shut = ~leads[top]
    kind = np.select([never, one & shut[a], one, shut[a] & shut[b]], ["done", "done", "open", "done"], "far")
    steps = pa.array((depth[a] + depth[b] - 2 * depth[at]).astype(np.int32), mask=~one)
    pairs = pa.table([doc.take(pa.array(a)), ids.take(pa.array(a)), rows.column("other").take(pa.array(a)), ids.take(pa.array(at, mask=~one)), steps, above.take(pa.array(top[a], mask=kind != "open")), pa.array(kind, pa.string())], names)

    out = pa.array(np.flatnonzero(~cycle[:n] & (depth[:n] % LONGEST == 0) & known & leads[:n]))
    out = pa.table([doc.take(out), above.take(out)], ["doc_id", "to"]).group_by(["doc_id", "to"]).aggregate([])
    none = lambda like: pa.nulls(out.num_rows, pairs.schema.field(like).type)
    return pa.concat_tables([pairs, pa.table([out.column("doc_id"), none("a"), none("b"), none("ancestor"), none("steps"), out.column("to"), pa.array(["target"] * out.num_rows, pa.string())], names)])


def linearized(nodes: DataFrame) -> DataFrame:
    """doc_id, ord, item (heading or paragraph), level, text and node_id in reading order: labelled inner nodes and leaves with text.

    `nodes` has kind, label, text, parent_id and sort_key (the children's places from the top), by which a document's nodes are numbered.
    """
    inner = nodes.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    rows = nodes.where("kind <> 'root'").join(inner, ["doc_id", "node_id"], "left")
    is_inner = F.coalesce("inner", F.lit(False))
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")) == "", F.lit(True))
    heading, leaf = is_inner & ~blank("label"), ~is_inner & (F.col("kind") == "paragraph") & ~blank("text")
    level = F.when(heading, F.when(F.col("kind") == "chapter", 1).when(F.col("kind") == "section", 2).otherwise(3))
    rows = rows.where(heading | leaf).select("doc_id", "node_id", "sort_key", F.when(heading, "heading").otherwise("paragraph").alias("item"), level.alias("level"), F.when(heading, F.trim("label")).otherwise(F.col("text")).alias("text"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("sort_key")) - 1
    return rows.select("doc_id", place.cast("long").alias("ord"), "item", "level", "text", "node_id")


def first_ids(nodes: DataFrame, n: int = 8) -> DataFrame:
    """doc_id and hint: the first n ids in document order, as an error about an unknown id names them."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("sort_key"))
    few = nodes.withColumn("place", place).where(F.col("place") <= n)
    return few.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node_id"))), lambda x: x["node_id"]).alias("ids"))
