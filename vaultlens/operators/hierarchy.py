"""Parent-child links to full hierarchies: components, depth-first walks, cycles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import shuffle_partitions
from ..session import Cut, cut

WHITE, GREY, BLACK = 0, 1, 2


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Component label of every node of a table (node, parent), each node once.

    ``parent`` is null for roots. Each round doubles the length of every node's pointer
    and keeps the smallest node passed; roots stop the walk. When a round brings no
    further node to its root, the remaining ones lead into a cycle, for a tree with
    open nodes always has one whose depth the next round covers. They then walk
    until the pointers are longer than any cycle can be, which a stable smallest node
    on the cycle shows.

    Columns: node, label (root, or smallest node of the cycle), steps (depth, -1 when the
    line never ends), cyclic.
    """
    rows = links.select("node", F.coalesce("parent", "node").alias("ptr"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("steps"), F.col("parent").isNull().alias("done"), F.least("node", F.coalesce("parent", "node")).alias("low"))
    held = Cut(rows, "walk")
    left = held.df.where("not done").count()
    stuck = False
    for _ in range(max_rounds):
        if not left:
            break
        a = held.df
        b = a.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("steps").alias("steps2"), F.col("done").alias("done2"), F.col("low").alias("low2"))
        closed = a.where("done")
        moved = a.where("not done").join(b, "ptr").select("node", F.col("ptr2").alias("ptr"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("done2").alias("done"), F.least("low", "low2").alias("low"), (F.least("low", "low2") < F.col("low")).alias("lower"))
        new = Cut(closed.withColumn("lower", F.lit(False)).unionByName(moved), "walk")
        state = new.df.agg(F.count(F.when(~F.col("done"), 1)).alias("open"), F.count(F.when(F.col("lower") & ~F.col("done"), 1)).alias("lower")).first()
        held.drop()
        held = new
        if stuck and not state["lower"]:
            left = state["open"]
            break
        stuck, left = state["open"] == left, state["open"]
    final = held.df
    if not left:
        return final.select("node", F.col("ptr").alias("label"), "steps", F.lit(False).alias("cyclic"))
    # a pointer that long stands on the cycle, and what is smallest from there is the cycle's smallest node
    at = final.where("not done").select(F.col("node").alias("ptr"), F.col("low").alias("label"))
    circling = final.where("not done").select("node", "ptr").join(at, "ptr").select("node", "label", F.lit(-1).cast("bigint").alias("steps"), F.lit(True).alias("cyclic"))
    return final.where("done").select("node", F.col("ptr").alias("label"), "steps", F.lit(False).alias("cyclic")).unionByName(circling)


PATH_BLOCK = 16 << 20  # characters of path text held at once


def _walk(batches: Iterator[pd.DataFrame], sep: str, with_path: bool) -> Iterator[pd.DataFrame]:
    """Iterative depth-first traversal of the components of one task, with node colours; children in order of their node."""
    parts = list(batches)
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True).sort_values("node", ignore_index=True)
    if not len(rows):
        return
    nodes = rows["node"].to_numpy()
    n = len(nodes)
    up = pd.Index(nodes).get_indexer(rows["parent"].where(rows["parent"].notna(), None)).astype(np.int64)
    up[rows["parent"].isna().to_numpy()] = -1
    order = np.argsort(up, kind="stable")
    first = np.searchsorted(up[order], np.arange(n)).tolist()
    last = np.searchsorted(up[order], np.arange(n), side="right").tolist()
    kids = order.tolist()
    colour = [WHITE] * n
    depth, root, entry, back = (np.full(n, -1, np.int64) for _ in range(4))
    below = [0] * n
    walked: list[int] = []
    # a cycle is entered at its label, its smallest node, which is then the one whose link closes it
    starts = [*np.flatnonzero(up < 0).tolist(), *np.flatnonzero((rows["node"] == rows["label"]).to_numpy() & (up >= 0)).tolist(), *np.flatnonzero(up >= 0).tolist()]
    for start in starts:
        if colour[start] != WHITE:
            continue
        rooted, begun = up[start] < 0, len(walked)
        colour[start] = GREY
        walked.append(start)
        if rooted:
            depth[start], root[start], entry[start] = 0, start, 0
        stack, turns = [start], [first[start]]
        while stack:
            at, turn = stack[-1], turns[-1]
            if turn == last[at]:
                colour[at] = BLACK
                stack.pop(), turns.pop()
                if stack:
                    below[stack[-1]] += below[at] + 1
                continue
            turns[-1] = turn + 1
            child = kids[turn]
            if colour[child] == GREY:
                back[child] = at  # the child is an ancestor of itself
            elif colour[child] == WHITE:
                colour[child] = GREY
                if rooted:
                    depth[child], root[child], entry[child] = len(stack), start, len(walked) - begun
                walked.append(child)
                stack.append(child), turns.append(first[child])
    # in walking order the line of a node is what remains of the line before, so paths are made and told in blocks
    line: list[str] = []
    block: list[int] = []
    texts: list[str | None] = []
    held = 0
    for i in walked:
        if with_path and depth[i] >= 0:
            del line[depth[i] :]
            line.append(str(nodes[i]))
            texts.append(sep.join(line))
            held += len(texts[-1])
        else:
            texts.append(None)
        block.append(i)
        if held > PATH_BLOCK or len(block) >= 100_000:
            yield _told(nodes, np.array(block), root, depth, texts, below, back, entry)
            block, texts, held = [], [], 0
    if block:
        yield _told(nodes, np.array(block), root, depth, texts, below, back, entry)


def _told(nodes, at, root, depth, texts, below, back, entry) -> pd.DataFrame:
    some = lambda x: np.where(x[at] >= 0, nodes[np.maximum(x[at], 0)], None)
    return pd.DataFrame({"node": nodes[at], "root": some(root), "depth": depth[at], "path": texts, "n_descendants": np.where(depth[at] >= 0, np.array([below[i] for i in at]), -1), "back_edge_from": some(back), "entry": entry[at]})


def hierarchy(links: DataFrame, *, node: str, parent: str, component_rows: int = 1_000_000, sep: str = "/", with_path: bool = True) -> DataFrame:
    """Root, depth, path, descendants and back edge of every node.

    A node with several rows counts once; if they name different parents, the smallest
    non-null one. A parent that is null or is no node itself makes a root of depth 0. A
    node whose line never ends has no root and no path, depth, n_descendants and entry -1;
    of each cycle the smallest node also tells its parent, with which the cycle closes (back_edge_from).
    Rows without node are left out; an empty table gives no rows; other columns are
    ignored.

    Columns: node, root, depth, path, n_descendants, back_edge_from, entry. ``entry`` numbers the nodes of a tree in the order of
    the depth-first walk, so the descendants of a node are those of its root with entries above its own, up to
    entry + n_descendants: one row a node tells them all.

    Components are found by pointer doubling, then whole components are co-located
    and walked depth first; paths leave the task in blocks. A component of more than ``component_rows`` nodes is never
    gathered: its depth-first walk is made by doubling too (``_tour``), with the same result. Paths are as long as all depths
    together, so ask for them only where they can be held.
    """
    rows = links.select(F.col(node).alias("node"), F.col(parent).alias("parent")).where(F.col("node").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent"))
    base = cut(rows, "links")
    known = base.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    base = cut(base.join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("parent")), "links")
    comp = cut(base.join(components(base), "node"), "components")
    large = cut(comp.groupBy("label").count().where(F.col("count") > component_rows).select("label"), "large")
    some = not large.isEmpty()
    small = comp.join(large, "label", "left_anti") if some else comp
    schema = "node string, root string, depth bigint, path string, n_descendants bigint, back_edge_from string, entry bigint"
    n = shuffle_partitions(base, 8 << 20)
    out = small.select("node", "parent", "label").repartition(n, "label").mapInPandas(lambda it: _walk(it, sep, with_path), schema)
    return out.unionByName(_large(comp.join(large, "label", "left_semi"), sep, with_path)) if some else out


def _large(comp: DataFrame, sep: str, with_path: bool) -> DataFrame:
    """Components too large for one task: the walk by doubling, paths (if asked for) from doubled lines."""
    trees = cut(comp.where("not cyclic"), "trees")
    done = trees.select("node", F.col("label").alias("root"), F.col("steps").alias("depth")).join(_tour(trees.select("node", "parent", "label")), "node")
    if with_path:
        path = ancestors(trees.select("node", "parent")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor"))).alias("up"))
        done = done.join(path, "node", "left").withColumn("path", F.concat_ws(sep, F.transform(F.coalesce("up", F.array()), lambda x: x["ancestor"]), F.col("node")))
    else:
        done = done.withColumn("path", F.lit(None).cast("string"))
    none, minus = F.lit(None).cast("string"), F.lit(-1).cast("bigint")
    done = done.select("node", "root", "depth", "path", "n_descendants", none.alias("back_edge_from"), "entry")
    return done.unionByName(comp.where("cyclic").select("node", none.alias("root"), minus.alias("depth"), none.alias("path"), minus.alias("n_descendants"), F.when(F.col("node") == F.col("label"), F.col("parent")).alias("back_edge_from"), minus.alias("entry")))


def _tour(trees: DataFrame, max_rounds: int = 80) -> DataFrame:
    """node, entry and n_descendants of trees (node, parent, label) of any size and depth, as a depth-first walk finds them.

    The walk enters and leaves each node once. After a node is entered, its first child is, or else it is left; after it is
    left, its next sibling is entered, or else the parent is left. These links make one line per tree. Doubling
    pointers along it count the nodes entered from each place to the end; their differences are entries and descendants.
    """
    kids = trees.where("parent is not null")
    eldest = kids.groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("child"))
    next_ = kids.select("node", F.lead("node").over(Window.partitionBy("parent").orderBy("node")).alias("sibling"))
    full = trees.join(eldest, "node", "left").join(next_, "node", "left")
    into, out = (lambda c: F.concat(F.lit("+"), c)), (lambda c: F.concat(F.lit("-"), c))
    enter = full.select(into(F.col("node")).alias("at"), F.coalesce(into(F.col("child")), out(F.col("node"))).alias("ptr"), F.lit(1).cast("bigint").alias("seen"))
    leave = full.select(out(F.col("node")).alias("at"), F.coalesce(into(F.col("sibling")), out(F.col("parent"))).alias("ptr"), F.lit(0).cast("bigint").alias("seen"))
    held = Cut(enter.unionByName(leave), "tour")
    for _ in range(max_rounds):
        if held.df.where("ptr is not null").isEmpty():
            break
        far = held.df.select(F.col("at").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("seen").alias("seen2"))
        new = Cut(held.df.where("ptr is null").unionByName(held.df.where("ptr is not null").join(far, "ptr").select("at", F.col("ptr2").alias("ptr"), (F.col("seen") + F.col("seen2")).alias("seen"))), "tour")
        held.drop()
        held = new
    else:
        raise RuntimeError(f"a tour didn't end in {max_rounds} rounds of doubling")
    name = F.substring("at", F.lit(2), F.length("at"))
    ends = held.df.select(name.alias("node"), F.when(F.col("at").startswith("+"), F.col("seen")).alias("i"), F.when(F.col("at").startswith("-"), F.col("seen")).alias("o")).groupBy("node").agg(F.max("i").alias("i"), F.max("o").alias("o"))
    size = trees.groupBy("label").agg(F.count("*").alias("size"))
    return trees.join(size, "label").select("node", "size").join(ends, "node").select("node", (F.col("size") - F.col("i")).alias("entry"), (F.col("i") - F.col("o") - 1).alias("n_descendants"))


def ancestors(trees: DataFrame, max_rounds: int = 64) -> DataFrame:
    """All (ancestor, node, distance) pairs of acyclic links (node, parent), by doubling.

    The result has one row per pair, as many as the depths of all nodes together.
    """
    lines = Cut(trees.where(F.col("parent").isNotNull()).select("node", F.col("parent").alias("ancestor"), F.lit(1).cast("bigint").alias("distance")), "lines")
    reach = 1
    for _ in range(max_rounds):
        far = lines.df.where(F.col("distance") == reach).select("node", F.col("ancestor").alias("mid"))
        more = lines.df.select(F.col("node").alias("mid"), "ancestor", (F.col("distance") + reach).alias("distance"))
        new = Cut(far.join(more, "mid").select("node", "ancestor", "distance"), "lines")
        if new.df.isEmpty():
            break
        both = Cut(lines.df.unionByName(new.df), "lines")
        lines.drop(), new.drop()
        lines, reach = both, reach * 2
    else:
        raise RuntimeError(f"lines longer than 2**{max_rounds}")
    return lines.df
