"""Parent-child links to full hierarchies: block-local leaf peeling and Euler tours, joined by parallel list ranking.

Nodes are range-partitioned in document order, so a block (one partition, of bounded size) holds whole subtrees as far as
possible. Within a block leaves are peeled; what can't be peeled lies on a cycle inside the block. Each block then walks the
Euler tours of its local roots. Where a node has children in other blocks (a port) the tour is cut into segments; the
segments of all blocks form linked lists, which are ranked by pointer jumping over the segments only: far fewer than nodes.
A list that never ends belongs to a cycle across blocks. Entry and exit positions of the whole tour follow by adding a
segment's offset, and give depth, descendants (nested intervals) and ancestors (enclosing intervals). Paths are put together last,
by streaming over each block in tour order with the labels of the open nodes on a stack.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docustrata.functions.text import is_blank
from docustrata.session import durable, target_partitions

#: Nodes a block holds about; bounds the memory of a task (some 400 bytes a node).
BLOCK = 40_000
#: Characters of paths that a batch holds about.
BATCH_CHARS = 4_000_000
_SEP = " > "
_OUT = "block int, pos int, open int, node string, parent string, label string, local_root string, cyclic boolean, seg_in string, off_in bigint, dep_in bigint, seg_out string, off_out bigint, lens bigint, deps bigint, next_seg string, kind int, path string"


def _peel(parent: dict[str, str | None]) -> tuple[list[str], set[str]]:
    """The nodes in an order in which children precede parents, and the nodes that lie on cycles."""
    waiting: dict[str, int] = defaultdict(int)
    for p in parent.values():
        if p is not None and p in parent:
            waiting[p] += 1
    leaves = [n for n in parent if not waiting[n]]
    for n in leaves:
        p = parent[n]
        if p is not None and p in parent:
            waiting[p] -= 1
            if not waiting[p]:
                leaves.append(p)
    return leaves, parent.keys() - set(leaves)


def _columns(batches: Iterator[pa.RecordBatch]) -> dict[str, list]:
    got = pa.Table.from_batches(list(batches)) if not isinstance(batches, pa.Table) else batches
    return {c: got[c].to_pylist() for c in got.column_names}


def _stubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parents outside the block, once each with the local roots' count: what a hot parent sends is one row per block."""
    rows = list(batches)
    if not rows:
        return
    c = _columns(rows)
    here = set(c["node"])
    outside = {p for p in c["parent"] if p is not None and p not in here}
    yield pa.RecordBatch.from_pydict({"parent": list(outside), "from_block": [c["block"][0]] * len(outside)}, pa.schema([("parent", pa.string()), ("from_block", pa.int32())]))


def _tours(nodes: pa.Table, ports: pa.Table) -> pa.Table:
    """One block: rows of kind 0 are nodes, of kind 1 segments.

    ``ports`` has the block's nodes with children elsewhere (role 'down', the blocks that hold them) and its outside parents
    (role 'up', the next block that hangs below the same parent). Only nodes with children elsewhere have their path below the local root.
    """
    c = _columns(nodes)
    if not c["node"]:
        return pa.table({f.name: pa.array([], f.type) for f in _SCHEMA}, _SCHEMA)
    block = c["block"][0]
    parent, label = dict(zip(c["node"], c["parent"])), dict(zip(c["node"], c["label"]))
    pc = _columns(ports)
    down = {n: to for n, role, to in zip(pc["parent"], pc["role"], pc["to_block"]) if role == "down"}
    up = {n: to for n, role, to in zip(pc["parent"], pc["role"], pc["to_block"]) if role == "up"}
    _, cyclic = _peel(parent)
    children: dict[str, list[str]] = defaultdict(list)
    hanging: dict[str, list[str]] = defaultdict(list)
    roots = []
    for n in c["node"]:  # in document order
        p = parent[n]
        if p is not None and p in parent and n not in cyclic:
            children[p].append(n)
        else:
            roots.append(n)
            if n not in cyclic and p in up:
                hanging[p].append(n)
    labelled = any(c["label"])
    pos = 0
    follows = {}  # the segment after a local root's last one
    for p, own in hanging.items():
        for a, b in zip(own, own[1:]):
            follows[a] = f"{b}/0"
        follows[own[-1]] = f"{p}@{up[p]}" if up[p] is not None else f"{p}!"
    out: dict[str, list] = {f.name: [] for f in _SCHEMA}

    def emit(**row) -> None:
        for k, v in out.items():
            v.append(row.get(k))

    for r in roots:
        bad = r in cyclic
        seg, n_seg, at, depth, base = f"{r}/0", 0, 0, 0, 0  # depth: open nodes since the root; base: those at the segment's start
        into: dict[str, tuple] = {}
        labels: list[str | None] = []  # of the open nodes
        todo: list[tuple[str, int]] = [(r, 0)]
        while todo:
            n, step = todo.pop()
            if step == 0:
                labels.append(label[n])
                depth += 1
                at += 1
                into[n] = (seg, at - 1, depth - base - 1, pos, depth - 1)
                pos += 1
                todo.append((n, 1))
                todo.extend((x, 0) for x in reversed(children[n]))
            else:
                port = n in down and not bad
                path = _SEP.join(filter(None, labels)) if port and labelled else None
                labels.pop()
                if port:
                    emit(kind=1, seg_in=seg, lens=at, deps=depth - base, next_seg=f"{n}@{down[n]}", local_root=r)
                    n_seg, at, base = n_seg + 1, 0, depth
                    seg = f"{n}!"
                depth -= 1
                at += 1
                s, o, d, i, open_ = into.pop(n)
                emit(kind=0, block=block, pos=i, open=open_, node=n, parent=parent[n], label=label[n], local_root=r, cyclic=bad, seg_in=s, off_in=o, dep_in=d, seg_out=seg, off_out=at - 1, path=path)
        emit(kind=1, seg_in=seg, lens=at, deps=depth - base, next_seg=follows.get(r), local_root=r, cyclic=bad)
    for p, own in hanging.items():  # the way into this block's children of an outside parent
        emit(kind=1, seg_in=f"{p}@{block}", lens=0, deps=0, next_seg=f"{own[0]}/0", local_root=own[0])
    return pa.table(out, _SCHEMA)


_SCHEMA = pa.schema([("block", pa.int32()), ("pos", pa.int32()), ("open", pa.int32()), ("node", pa.string()), ("parent", pa.string()), ("label", pa.string()), ("local_root", pa.string()), ("cyclic", pa.bool_()), ("seg_in", pa.string()), ("off_in", pa.int64()), ("dep_in", pa.int64()), ("seg_out", pa.string()), ("off_out", pa.int64()), ("lens", pa.int64()), ("deps", pa.int64()), ("next_seg", pa.string()), ("kind", pa.int32()), ("path", pa.string())])


def _rank(segments: DataFrame) -> DataFrame:
    """Pointer jumping: for each segment of a list that ends, its last segment, the steps to the end and the open nodes at its start.

    A round that ends nothing new leaves only lists without an end, as distances to the end have no gaps.
    """
    state = durable(segments.select("seg_in", F.col("next_seg").alias("jump"), F.col("lens").alias("rest"), F.col("deps").alias("net"), F.when(F.col("next_seg").isNull(), F.col("seg_in")).alias("last")))
    open_ones = state.where("last is null").count()
    while open_ones:
        far = state.select(F.col("seg_in").alias("jump"), F.col("jump").alias("j2"), F.col("rest").alias("r2"), F.col("net").alias("n2"), F.col("last").alias("l2"))
        ended, going = state.where("last is not null"), state.where("last is null")
        moved = going.join(far, "jump", "left").select("seg_in", F.col("j2").alias("jump"), (F.col("rest") + F.coalesce("r2", F.lit(0))).alias("rest"), (F.col("net") + F.coalesce("n2", F.lit(0))).alias("net"), F.col("l2").alias("last"))
        state = durable(ended.unionByName(moved))
        still = state.where("last is null").count()
        if still == open_ones:
            break
        open_ones = still
    return state


def hierarchy(nodes: DataFrame, node: str = "id", parent: str = "parent_node_id", order: tuple[str, ...] = ("version_id", "order_index"), label: Column | None = None, block: int = BLOCK) -> DataFrame:
    """One row per node: node_id, parent_id, root_id, tree_depth, entry, exit, n_descendants, is_cyclic, path (labels joined by ' > ').

    A parent that is null, blank or the id of no row makes the node a root of depth 0. Nodes on a cycle or below one have root_id
    '', tree_depth -1 and null entry, exit, n_descendants and path. Rows with a null id are left out; an id with several rows counts
    once (of differing rows the least by order and parent). Without ``label`` paths are null. ``order`` decides the order of siblings and which nodes share a block;
    any order gives the same roots and depths. Labels that are null or empty are left out of paths.
    """
    wanted = label is not None
    label = label if wanted else F.lit(None).cast("string")
    keys = [f"o{i}" for i in range(len(order))]
    fields = [*[F.col(c).alias(k) for c, k in zip(order, keys)], F.when(~is_blank(F.col(parent)), F.col(parent)).alias("parent"), label.alias("label")]
    single = nodes.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(F.struct(*fields)).alias("v")).select("node", "v.*")
    single = durable(single)
    spark = nodes.sparkSession
    parts = max(1, min(target_partitions(spark, n := single.count(), block), -(-n // 2_000)))
    placed = durable(single.repartitionByRange(parts, *keys, "node").sortWithinPartitions(*keys, "node").withColumn("block", F.spark_partition_id()).select("block", "node", "parent", "label", *keys))
    stubs = durable(placed.select("block", "node", "parent").mapInArrow(_stubs, "parent string, from_block int"))
    home = placed.select(F.col("node").alias("parent"), F.col("block").alias("home"))
    # a parent hangs below as many rows as blocks: at most one for each, never one for each child
    links = stubs.join(home, "parent", "inner").groupBy("parent", "home").agg(F.sort_array(F.collect_set("from_block")).alias("blocks"))
    ports = links.select(F.col("home").alias("block"), "parent", F.lit("down").alias("role"), F.col("blocks")[0].alias("to_block")).unionByName(
        links.select(F.posexplode("blocks").alias("i", "block"), "parent", "blocks").select("block", "parent", F.lit("up").alias("role"), F.get("blocks", F.col("i") + 1).alias("to_block"))
    )
    toured = durable(placed.select("block", "node", "parent", "label", *keys).groupBy("block").cogroup(ports.groupBy("block")).applyInArrow(_sorted_tours(keys), _OUT))
    segments, rows = toured.where("kind = 1"), toured.where("kind = 0")
    ranked = _rank(segments.where("not coalesce(cyclic, false)"))
    root_of = segments.select(F.col("seg_in").alias("last"), F.col("local_root").alias("root"))
    # what ends in a segment of a root that is cyclic or hangs nowhere; the whole length of a tour is the rest at its first segment
    ends = ranked.where("last is not null").join(root_of, "last").select("seg_in", "rest", "net", "root")
    length = ends.where(F.col("seg_in") == F.concat("root", F.lit("/0"))).select("root", F.col("rest").alias("whole"))
    starts = ends.join(length, "root").select("seg_in", "root", (F.col("whole") - F.col("rest")).alias("start"), (-F.col("net")).alias("depth0"))
    a, b = starts, starts.select(F.col("seg_in").alias("seg_out"), F.col("start").alias("start_out"))
    found = rows.drop("path").join(a, "seg_in", "left").join(b, "seg_out", "left")
    ok = F.col("root").isNotNull() & ~F.col("cyclic")
    entry, leave = F.col("start") + F.col("off_in"), F.col("start_out") + F.col("off_out")
    out = [
        F.col("node").alias("node_id"),
        F.col("parent").alias("parent_id"),
        F.when(ok, F.col("root")).otherwise("").alias("root_id"),
        F.when(ok, F.col("depth0") + F.col("dep_in")).otherwise(-1).cast("int").alias("tree_depth"),
        F.when(ok, entry).alias("entry"),
        F.when(ok, leave).alias("exit"),
        F.when(ok, ((leave - entry - 1) / 2).cast("bigint")).alias("n_descendants"),
        (~ok).alias("is_cyclic"),
    ]
    if not wanted:
        return found.select(*out, F.lit(None).cast("string").alias("path"))
    # what stands before a block's paths goes to the row of the local root only
    found = found.join(_prefixes(rows).withColumnRenamed("local_root", "node"), "node", "left").select(*out, "block", "pos", "open", "label", "prefix")
    ordered = found.repartition("block").sortWithinPartitions("block", "pos")
    return ordered.mapInArrow(_paths, "node_id string, parent_id string, root_id string, tree_depth int, entry bigint, exit bigint, n_descendants bigint, is_cyclic boolean, path string")


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of nodes in tour order; holds the labels of the open nodes and one batch of paths, however deep a tree is."""
    labels: list[str | None] = []
    names = ["node_id", "parent_id", "root_id", "tree_depth", "entry", "exit", "n_descendants", "is_cyclic"]
    for batch in batches:
        start, size, made = 0, 0, []

        def cut(end: int) -> pa.RecordBatch:
            part = batch.slice(start, end - start)  # noqa: B023
            return pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(made, pa.string())], [*names, "path"])  # noqa: B023

        for i, (bad, open_, label, prefix) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("is_cyclic", "open", "label", "prefix")))):
            del labels[open_ + 1 :]  # the first is what stands before the block's paths
            if not open_:
                labels[:] = [prefix]
            labels.append(label)
            made.append(None if bad else _SEP.join(filter(None, labels)))
            size += len(made[-1] or "")
            if size > BATCH_CHARS:
                yield cut(i + 1)
                start, size, made = i + 1, 0, []
        if made:
            yield cut(batch.num_rows)


def _sorted_tours(keys: list[str]):
    def run(nodes: pa.Table, ports: pa.Table) -> pa.Table:
        return _tours(nodes.sort_by([(k, "ascending") for k in (*keys, "node")]), ports)

    return run


def _prefixes(rows: DataFrame) -> DataFrame:
    """For each local root below a port its ancestors' labels, by pointer jumping over local roots."""
    below = rows.where("node = local_root and parent is not null and not cyclic").select("local_root", "parent")
    over = rows.where("not cyclic").select(F.col("node").alias("parent"), F.col("local_root").alias("jump"), F.col("path").alias("prefix"))
    state = durable(below.join(over, "parent").select("local_root", "jump", "prefix"))
    left, before = state.where("jump is not null").count(), -1
    while left and left != before:
        far = state.select(F.col("local_root").alias("jump"), F.col("jump").alias("j2"), F.col("prefix").alias("p2"))
        state = durable(state.join(far, "jump", "left").select("local_root", F.col("j2").alias("jump"), F.concat_ws(_SEP, F.nullif("p2", F.lit("")), F.nullif("prefix", F.lit(""))).alias("prefix")))
        before, left = left, state.where("jump is not null").count()
    return state.select("local_root", "prefix")


def descendants_of(tree: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Pairs (ancestor_id, node_id) for the ids in ``wanted`` (column node_id; all nodes if none is given): all nodes nested in their intervals.

    The interval join is an equi-join: an interval is cut into its aligned parts (at most two of each power of two), and a node asks
    for the one part of each size that holds its entry. Every row that the join makes is a pair of the result.
    """
    sound = tree.where("not is_cyclic").select("node_id", "root_id", "entry", "exit")
    longest = sound.agg(F.max("exit")).first()[0] or 0
    sizes = F.sequence(F.lit(0), F.lit(max(1, int(longest).bit_length())))
    tops = sound if wanted is None else sound.join(wanted.select("node_id").distinct(), "node_id", "left_semi")
    none = F.array().cast("array<struct<size:int,at:bigint>>")

    def step(acc: Column, size: Column) -> Column:
        lo, hi, open_ = acc["lo"], acc["hi"], acc["lo"] <= acc["hi"]
        part = lambda c: F.array(F.struct(size.cast("int").alias("size"), c.alias("at")))
        low = F.when(open_ & (lo % 2 == 1), part(lo)).otherwise(none)
        high = F.when(open_ & (hi % 2 == 0) & ((lo % 2 == 0) | (hi > lo)), part(hi)).otherwise(none)
        return F.struct(F.shiftright(lo + lo % 2, 1).alias("lo"), (F.shiftright(hi + 1, 1) - 1).alias("hi"), F.concat(acc["parts"], low, high).alias("parts"))

    start = F.struct((F.col("entry") + 1).alias("lo"), (F.col("exit") - 1).alias("hi"), none.alias("parts"))
    cut = tops.where("exit > entry + 1").select(F.col("node_id").alias("ancestor_id"), "root_id", F.explode(F.aggregate(sizes, start, step)["parts"]).alias("p")).select("ancestor_id", "root_id", "p.size", "p.at")
    asked = sound.where("node_id <> root_id").select("node_id", "root_id", "entry", F.explode(sizes).alias("size")).select("node_id", "root_id", "size", F.expr("shiftright(entry, size)").alias("at"))
    return cut.join(asked, ["root_id", "size", "at"]).select("ancestor_id", "node_id")
