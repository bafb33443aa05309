"""Connected regions of grids of any size: tiles are labelled one by one, then only labels that meet at tile borders are joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlake.functions import kernels
from patchlake.sources.storage import materialize

_HALF = 1 << 31
#: Rows that a task looks at together, about.
ROWS = 250_000
#: Tiles along the side of a block, whose border labels are joined in one group.
BLOCK = 16


def _unsent(df: DataFrame) -> DataFrame:
    """For a join in which neither side is broadcast: Spark goes by the size of the files, and labels that repeat from image to image pack to few bytes a row."""
    return df.hint("merge")


def least_connected(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, least) for every node of the edges (keys, a, b): the smallest node that it is connected with.

    The graph is contracted round by round: each node hooks to the neighbour whose hash (another one every round) is the least, or stays if its own is;
    two jumps along the hooks, then edges are renamed to the hooks' ends and those inside a group drop out. About half of the nodes go in a
    round, and only equi-joins and minima are used.
    """
    left = materialize(edges.select(*keys, "a", "b").filter("a <> b").distinct(), "edges")
    at = materialize(left.select(*keys, F.col("a").alias("node")).union(left.select(*keys, F.col("b").alias("node"))).distinct().withColumn("top", F.col("node")), "tops")
    turn = 0
    while not left.isEmpty():
        turn += 1
        draw = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        both = left.select(*keys, "a", "b").union(left.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(*keys, F.col("a").alias("n0")).agg(F.min(draw("b")).alias("m"))
        hooks = materialize(hooks.select(*keys, "n0", F.least("m", draw("n0")).getField("n").alias("n1")), "hooks")
        step = hooks.select(*keys, F.col("n0").alias("n1"), F.col("n1").alias("n2"))
        for _ in range(2):
            hooks = hooks.join(_unsent(step), [*keys, "n1"]).select(*keys, "n0", F.col("n2").alias("n1"))
        hooks = materialize(hooks, "jumps")
        for end in "ab":
            left = left.join(_unsent(hooks.withColumnsRenamed({"n0": end, "n1": f"_{end}"})), [*keys, end]).drop(end).withColumnRenamed(f"_{end}", end)
        left = materialize(left.filter("a <> b").distinct(), "edges")
        moved = at.join(_unsent(hooks.withColumnsRenamed({"n0": "top", "n1": "_to"})), [*keys, "top"], "left")
        at = materialize(moved.select(*keys, "node", F.coalesce("_to", "top").alias("top")), "tops")
    least = at.groupBy(*keys, "top").agg(F.min("node").alias("least"))
    return at.join(_unsent(least), [*keys, "top"]).select(*keys, "node", "least")


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns of ROWS rows or more, as far as there are, of rows sorted by `by`, with the number of each row's group; a group is never cut."""
    held, many, least = [], 0, ROWS
    for batch in batches:
        held.append(batch)
        many += batch.num_rows
        if many < least:
            continue
        told = pa.Table.from_batches(held)
        out, own = _numbered(told, by)
        last = int(np.searchsorted(own, own[-1]))
        if last:
            yield {k: v[:last] for k, v in out.items()}, own[:last]
        held = told.slice(last).combine_chunks().to_batches()
        many -= last
        least = max(ROWS, 2 * many)
    if many:
        yield _numbered(pa.Table.from_batches(held), by)


def _numbered(told: pa.Table, by: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    out = {name: told.column(name).to_numpy() for name in told.column_names}
    return out, np.cumsum(_changes(*(out[c] for c in by))) - 1


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where one of the columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _arrays(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def _label_tiles(batches: Iterator[pa.RecordBatch], ks: list[str], tile: int) -> Iterator[pa.RecordBatch]:
    """Pieces (ks, piece, ys, xs, bys, bxs) of cells (ks, _ty, _tx, y, x) sorted by tile: all cells, and those at the tile's border, each once."""
    for cells, own in _whole_groups(batches, [*ks, "_ty", "_tx"]):
        keys, width = kernels.place_keys(own, cells["y"], cells["x"])
        order = np.argsort(keys, kind="stable")
        new = _changes(keys[order])
        places = keys[order][new]
        root = kernels.least_linked(*kernels.touching(places, width), len(places))[np.cumsum(new) - 1]
        by_piece = np.argsort(root, kind="stable")
        order, new, first = order[by_piece], new[by_piece], np.flatnonzero(_changes(root[by_piece]))
        y, x = cells["y"][order], cells["x"][order]
        at = lambda c: np.isin(c % tile, (0, tile - 1))
        rim = new & (at(y) | at(x))
        ends = np.append(first, len(y))
        rims = np.concatenate(([0], np.cumsum(rim)))[ends]
        piece = y[first].astype(np.int64) * (1 << 32) + x[first] + _HALF
        lists = [_arrays(ends, y), _arrays(ends, x), _arrays(rims, y[rim]), _arrays(rims, x[rim])]
        yield pa.RecordBatch.from_arrays([pa.array(cells[k][order[first]]) for k in ks] + [pa.array(piece), *lists], [*ks, "piece", "ys", "xs", "bys", "bxs"])


def _join_blocks(batches: Iterator[pa.RecordBatch], ks: list[str]) -> Iterator[pa.RecordBatch]:
    """(ks, piece, root) of border cells (ks, _by, _bx, y, x, piece) sorted by block: the first piece that one meets within its block, if that is another."""
    for cells, own in _whole_groups(batches, [*ks, "_by", "_bx"]):
        keys, width = kernels.place_keys(own, cells["y"], cells["x"])
        order = np.argsort(keys, kind="stable")
        piece, own = cells["piece"][order], own[order]
        by_piece = np.lexsort((piece, own))
        new = _changes(own[by_piece], piece[by_piece])
        node = np.empty(len(piece), np.int64)
        node[by_piece] = np.cumsum(new) - 1
        head = by_piece[new]
        a, b = kernels.touching(keys[order], width)
        root = kernels.least_linked(node[a], node[b], len(head))
        moved = np.flatnonzero(root != np.arange(len(head)))
        yield pa.RecordBatch.from_arrays([pa.array(cells[k][order[head[moved]]]) for k in ks] + [pa.array(piece[head[moved]]), pa.array(piece[head[root[moved]]])], [*ks, "piece", "root"])


def connected_regions_tiled(mask: DataFrame, keys: tuple[str, ...] = ("image_id", "class_id"), tile: int = 512) -> DataFrame:
    """(keys, y, x, region_id): what connected_regions gives, for any tile size, without a group that holds more than a tile of one image and class.

    Each tile is labelled by the first cell of a piece. Border cells of BLOCK x BLOCK tiles look for their neighbours in one group, and labels that meet are
    joined there; labels that meet at the borders of blocks are contracted to the first cell of the whole region. Tasks take many tiles or blocks at once, as
    numbers of their places. Pieces travel as arrays of cells. Regions are numbered from 1 in raster order of that cell: within a row of
    cells, after the counts of the rows before. Repeated cells come out as often as they stand; cells with a null key or place are left out.
    """
    ks = list(keys)
    block = tile * BLOCK
    cells = mask.select(*[F.col(k).cast("long").alias(k) for k in ks], F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).dropna()
    part = lambda c, side: F.floor(F.col(c) / side)
    tiled = cells.withColumns({"_ty": part("y", tile), "_tx": part("x", tile)})
    tiled = tiled.repartition(*ks, "_ty", "_tx").sortWithinPartitions(*ks, "_ty", "_tx")
    held = ", ".join(f"{k} long" for k in ks)
    schema = f"{held}, piece long, ys array<int>, xs array<int>, bys array<int>, bxs array<int>"
    pieces = materialize(tiled.mapInArrow(lambda batches: _label_tiles(batches, ks, tile), schema), "pieces")
    border = pieces.select(*ks, "piece", F.explode(F.arrays_zip("bys", "bxs")).alias("c")).select(*ks, "piece", F.col("c.bys").alias("y"), F.col("c.bxs").alias("x"))
    blocks = border.withColumns({"_by": part("y", block), "_bx": part("x", block)})
    blocks = blocks.repartition(*ks, "_by", "_bx").sortWithinPartitions(*ks, "_by", "_bx")
    inner = materialize(blocks.mapInArrow(lambda batches: _join_blocks(batches, ks), f"{held}, piece long, root long"), "blocks")

    edge = lambda c: F.pmod(c, F.lit(block)).isin(0, block - 1)
    rim = border.filter(edge(F.col("y")) | edge(F.col("x")))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    near = rim.select(*ks, F.col("piece").alias("a"), "y", "x", F.explode(steps).alias("s")).select(*ks, "a", "y", "x", (F.col("y") + F.col("s.dy")).alias("_y"), (F.col("x") + F.col("s.dx")).alias("_x"))
    near = near.filter((part("y", block) != part("_y", block)) | (part("x", block) != part("_x", block))).select(*ks, "a", F.col("_y").alias("y"), F.col("_x").alias("x"))
    met = near.join(_unsent(rim.withColumnRenamed("piece", "b")), [*ks, "y", "x"]).select(*ks, "a", "b").distinct()
    for end in "ab":
        met = met.join(_unsent(inner.withColumnsRenamed({"piece": end, "root": "_root"})), [*ks, end], "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    outer = least_connected(met, ks).withColumnsRenamed({"node": "root", "least": "_least"})

    found = pieces.select(*ks, "piece").join(_unsent(inner), [*ks, "piece"], "left").withColumn("root", F.coalesce("root", "piece"))
    found = found.join(_unsent(outer), [*ks, "root"], "left").select(*ks, "piece", F.coalesce("_least", "root").alias("root"))
    found = materialize(found, "roots")
    roots = found.filter("piece = root").select(*ks, "root", F.shiftright("root", 32).alias("_y"))
    before = F.sum("_n").over(Window.partitionBy(*ks).orderBy("_y")) - F.col("_n")
    lines = roots.groupBy(*ks, "_y").agg(F.count("*").alias("_n")).select(*ks, "_y", before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy(*ks, "_y").orderBy("root"))
    ids = roots.withColumn("_nth", nth).join(_unsent(lines), [*ks, "_y"]).select(*ks, "root", (F.col("_before") + F.col("_nth")).cast("int").alias("region_id"))
    numbered = found.join(_unsent(ids), [*ks, "root"]).select(*ks, "piece", "region_id")
    named = pieces.select(*ks, "piece", "ys", "xs").join(_unsent(numbered), [*ks, "piece"])
    out = named.select(*ks, "region_id", F.explode(F.arrays_zip("ys", "xs")).alias("c"))
    return out.select(*ks, F.col("c.ys").alias("y"), F.col("c.xs").alias("x"), "region_id")
