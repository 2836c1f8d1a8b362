"""Parent-child rows of unknown depth to full hierarchies.

1. Leaves are peeled in doubling steps: f being "parent of", the image of f^(2^k) is what 2^k
   rounds of peeling leave. Nodes whose way up ends are trees; what never shrinks is cycles.
2. Each tree becomes an Euler tour, one linked list of down and up arcs, with siblings linked
   in two levels so that a parent with very many children is no single group.
3. The list is ranked by pointer jumping: log2(longest tour) joins give every arc its distance
   and its sum of +1/-1 to the end, hence depth, root and the entry-exit interval.
4. Paths and descendants are read from the intervals, in blocks of a tour.
All steps are joins on long ids; each round's table is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import Scratch

#: Groups in which the children of one parent are linked.
SIBLING_GROUPS = 64
#: Positions of a tour that one block holds, and ids of paths that a task holds before it emits them.
TOUR_BLOCK, PATH_IDS = 4096, 200_000


def _encode(links: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """(nid, id) of all nodes, and (v, p): p null for a root. A child of several parents keeps the smallest."""
    up = links.where("child is not null and parent is not null").groupBy("child").agg(F.min("parent").alias("parent"))
    up = s.cut(up)
    ids = up.select(F.col("child").alias("id")).union(up.select("parent")).distinct()
    nodes = s.cut(ids.select(F.monotonically_increasing_id().alias("nid"), "id"))
    child = nodes.select(F.col("nid").alias("v"), F.col("id").alias("child"))
    parent = nodes.select(F.col("nid").alias("p"), F.col("id").alias("parent"))
    tree = s.cut(child.join(up, "child", "left").join(parent, "parent", "left").select("v", "p"))
    s.drop(up)
    return nodes, tree


def _peel(tree: DataFrame, s: Scratch) -> DataFrame:
    """(v, j) of the nodes whose way up never ends; j lies on the cycle at its end."""
    jump, n = s.cut_counting(tree.where("p is not null").select("v", F.col("p").alias("j")))
    alive, image = n["rows"], None
    while alive:
        b = jump.select(F.col("v").alias("j"), F.col("j").alias("jj"))
        step, n = s.cut_counting(jump.join(b, "j").select("v", F.col("jj").alias("j")))
        s.drop(jump)
        jump, before, alive = step, alive, n["rows"]
        if alive and alive == before:  # no tree is left; go on until only cycles are in the image
            now = jump.select("j").distinct().count()
            if now == image:
                break
            image = now
    return jump


def _cycle_minima(cyclic: DataFrame, tree: DataFrame, nodes: DataFrame, s: Scratch) -> DataFrame:
    """(j, root_id) for the nodes on cycles: the smallest id on the cycle."""
    on = cyclic.select(F.col("j").alias("v")).distinct()
    ring = on.join(tree, "v").join(nodes.withColumnRenamed("nid", "v"), "v").select("v", F.col("p").alias("j"), F.col("id").alias("m"))
    ring = s.cut(ring)
    while True:
        b = ring.select(F.col("v").alias("j"), F.col("j").alias("jj"), F.col("m").alias("mm"))
        step = ring.join(b, "j").select("v", F.col("jj").alias("j"), F.least("m", "mm").alias("m"), (F.col("mm") < F.col("m")).alias("less"))
        step, n = s.cut_counting(step, less=F.sum(F.col("less").cast("int")))
        s.drop(ring)
        ring = step.select("v", "j", "m")
        ring._scratch_path = step._scratch_path
        if not n["less"]:
            return ring.select(F.col("v").alias("j"), F.col("m").alias("root_id"))


def _tour(forest: DataFrame) -> DataFrame:
    """(a, nxt, w): arcs 2v (down into v) and 2v+1 (up from v) of forest (v, p), with each one's successor."""
    kids = forest.where("p is not null").withColumn("g", F.pmod(F.xxhash64("v"), F.lit(SIBLING_GROUPS)))
    kids = kids.withColumn("sib", F.lead("v").over(Window.partitionBy("p", "g").orderBy("v")))
    first = kids.groupBy("p", "g").agg(F.min("v").alias("first"))
    by_group = Window.partitionBy("p").orderBy("g")
    first = first.select("p", "g", "first", F.lead("first").over(by_group).alias("after"), F.row_number().over(by_group).alias("k"))
    linked = kids.join(first.select("p", "g", "after"), ["p", "g"]).select("v", "p", F.coalesce("sib", "after").alias("sib"))
    roots = forest.where("p is null").select("v", "p", F.lit(None).cast("bigint").alias("sib"))
    every = linked.unionByName(roots)
    eldest = first.where("k = 1").select(F.col("p").alias("v"), F.col("first").alias("kid"))
    every = every.join(eldest, "v", "left")
    down = F.struct(
        (F.col("v") * 2).alias("a"), F.coalesce(F.col("kid") * 2, F.col("v") * 2 + 1).alias("nxt"), F.lit(1).cast("bigint").alias("w")
    )
    up = F.struct(
        (F.col("v") * 2 + 1).alias("a"), F.coalesce(F.col("sib") * 2, F.col("p") * 2 + 1).alias("nxt"), F.lit(-1).cast("bigint").alias("w")
    )
    return every.select(F.inline(F.array(down, up)))


def _rank(arcs: DataFrame, s: Scratch) -> DataFrame:
    """(a, d, w, last): arcs to the end of the list and the sum of w over them, both with a itself, and the last arc."""
    lists, n = s.cut_counting(
        arcs.select("a", "nxt", F.lit(1).cast("bigint").alias("d"), "w", F.col("a").alias("last")), open=F.count("nxt")
    )
    while n["open"]:
        ahead = lists.select(*[F.col(c).alias(f"{c}_") for c in ("a", "nxt", "d", "w", "last")])
        on = lists.where("nxt is not null").join(ahead, F.col("nxt") == F.col("a_"))
        on = on.select("a", F.col("nxt_").alias("nxt"), (F.col("d") + F.col("d_")).alias("d"), (F.col("w") + F.col("w_")).alias("w"), F.col("last_").alias("last"))
        step, n = s.cut_counting(on.unionByName(lists.where("nxt is null")), open=F.count("nxt"))
        s.drop(lists)
        lists = step
    return lists


def _tours(links: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node_id, root_id, depth, tour_start, tour_end, v, r) of the nodes of trees, as a table, and (node_id, root_id) of those whose way up ends in a cycle."""
    nodes, tree = _encode(links, s)
    cyclic = _peel(tree, s)
    minima = _cycle_minima(cyclic, tree, nodes, s)
    ranked = _rank(_tour(tree.join(cyclic, "v", "left_anti")), s)

    name = nodes.select(F.col("nid").alias("v"), F.col("id").alias("node_id"))
    sides = ranked.select(F.shiftright("a", 1).alias("v"), (F.col("a") % 2).alias("up"), "d", "w", F.shiftright("last", 1).alias("r"))
    per = sides.groupBy("v").agg(
        F.max("r").alias("r"),
        F.max(F.when(F.col("up") == 0, F.col("d"))).alias("down_d"),
        F.max(F.when(F.col("up") == 1, F.col("d"))).alias("up_d"),
        F.max(F.when(F.col("up") == 0, -F.col("w"))).alias("depth"),
    )
    per = s.cut(per)
    size = per.where("v = r").select("r", F.col("down_d").alias("total"))
    root = size.join(nodes.select(F.col("nid").alias("r"), F.col("id").alias("root_id")), "r")
    trees = per.join(root, "r").join(name, "v")
    trees = trees.select("node_id", "root_id", "depth", (F.col("total") - F.col("down_d")).alias("tour_start"), (F.col("total") - F.col("up_d")).alias("tour_end"), "r")
    s.drop(tree, ranked)
    return trees, cyclic.join(minima, "j").join(name, "v").select("node_id", "root_id")


_ROWS = ["node_id", "root_id", "depth", "tour_start", "tour_end", "descendants"]


def _rows(trees: DataFrame, cycles: DataFrame) -> DataFrame:
    below = ((F.col("tour_end") - F.col("tour_start") - 1) / 2).cast("bigint").alias("descendants")
    none = F.lit(None).cast("bigint")
    ring = cycles.select("node_id", "root_id", F.lit(-1).cast("bigint").alias("depth"), *[none.alias(c) for c in _ROWS[3:]])
    return trees.select(*_ROWS[:5], below).unionByName(ring)


def hierarchy(links: DataFrame) -> DataFrame:
    """Rows (node_id, root_id, depth, tour_start, tour_end, descendants) of links (child, parent).

    Links with a null end are left out, repeated ones count once; a child of several parents is
    placed under the smallest. tour_start < x < tour_end holds for the tour_start x of exactly the
    descendants, within one root. A node whose way up ends in a cycle (a self-link is one) has
    depth -1, the smallest id on that cycle as root_id, and null for the rest. No links, no rows.
    """
    return _rows(*_tours(links, Scratch(links.sparkSession, "hierarchy")))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths of a block's nodes: in the order of their entries, the last node of each smaller depth is an ancestor."""
    here, way, out, size = None, [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.list_(pa.string())))], names=["node_id", "path"])

    for b in batches:
        for r, block, depth, node, own in zip(*(b.column(c).to_pylist() for c in ("r", "block", "depth", "node_id", "own"))):
            if (r, block) != here:
                here, way = (r, block), []
            del way[depth:]
            way.append(node)
            if own:
                out.append((node, way.copy()))
                size += depth + 1
                if size > PATH_IDS:
                    yield batch()
                    out, size = [], 0
    if out:
        yield batch()


def _paths(trees: DataFrame) -> DataFrame:
    """(node_id, path) from the entry-exit intervals: tours are cut in blocks, and each block gets, beside its own
    nodes, those whose interval covers its beginning: the ancestors that are open there."""
    first, last = F.floor(F.col("tour_start") / TOUR_BLOCK).cast("bigint"), F.floor(F.col("tour_end") / TOUR_BLOCK).cast("bigint")
    rows = trees.select("r", "depth", "tour_start", "node_id", first.alias("first"), F.explode(F.sequence(first, last)).alias("block"))
    rows = rows.select("r", "block", "tour_start", F.col("depth").cast("int"), "node_id", (F.col("block") == F.col("first")).alias("own"))
    return rows.repartition("r", "block").sortWithinPartitions("r", "block", "tour_start").mapInArrow(_walk, "node_id string, path array<string>")


def hierarchy_with_paths(links: DataFrame) -> DataFrame:
    """The rows of hierarchy() with path: the ids from the root down to the node, null at and above cycles."""
    s = Scratch(links.sparkSession, "hierarchy")
    trees, cycles = _tours(links, s)
    trees = s.cut(trees)
    return _rows(trees, cycles).join(_paths(trees), "node_id", "left")


def paths(links: DataFrame) -> DataFrame:
    """Rows (node_id, path): the ids from the root down to the node, for nodes of trees. Nodes at or above cycles are not given."""
    s = Scratch(links.sparkSession, "paths")
    return _paths(s.cut(_tours(links, s)[0]))


def descendants(links: DataFrame) -> DataFrame:
    """Rows (node_id, descendant_id, distance) for every node of a tree and each one below it: those on whose path it is."""
    way = paths(links)
    return way.select(F.posexplode("path").alias("at", "node_id"), F.col("node_id").alias("descendant_id"), F.size("path").alias("k")).select(
        "node_id", "descendant_id", (F.col("k") - 1 - F.col("at")).cast("bigint").alias("distance")
    ).where("distance > 0")
