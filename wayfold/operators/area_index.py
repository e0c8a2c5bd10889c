"""An index of polygons by cells that split where many edges lie, and points in polygons through it.

A cell that no edge touches lies wholly inside or outside; an outside one is left out, an inside one has no edges. Another
cell keeps the edges that touch it. A point is inside if an odd number of edges crosses the way from it east without end.
Edges that pass a cell in the east are not kept: all points of the cell to the south of an edge's end and to the north of
its other end meet it, so only ends within the cell's rows at which their number changes matter. These are kept as upright
edges that begin there, and a cell says whether the number is odd at its north. So each edge is judged by the same
comparison as if all edges were held against the point, and a point on an edge has one answer. All rings of a polygon count
alike, so holes and islands within them follow from the even-odd rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.plans.storage import stored

#: Degrees of a cell's side by level; each divides the one before eight times.
SIDES = (2.0, 0.25, 0.03125)
SPLIT = 8
#: Bytes of the cells of a level that may be sent to all executors.
BROADCAST_BYTES = 32 << 20
#: Degrees, above what rounding does to the place where an edge crosses a parallel.
_SLACK = 1e-9
#: A longitude in the east of all points, for edges that stand for others.
_FAR = 1e6
#: Cells times edges held at once.
_HELD = 1 << 20
_EDGES = "array<struct<y1:double,x1:double,y2:double,x2:double>>"


def edges_of(rings: list[list[dict]] | None) -> np.ndarray:
    """(y1, x1, y2, x2) of each corner and the one before it; rings of fewer than three corners have no area."""
    out = []
    for ring in rings or []:
        corners = np.array([(p["lat"], p["lon"]) for p in ring or [] if p and p["lat"] is not None and p["lon"] is not None], float).reshape(-1, 2)
        if len(corners) >= 3:
            out.append(np.hstack([corners, np.roll(corners, 1, axis=0)]))
    return np.concatenate(out) if out else np.empty((0, 4))


def _parted(south: np.ndarray, west: np.ndarray, side: float, edges: np.ndarray) -> list[tuple[bool, np.ndarray]]:
    """For each cell, whether an odd number of edges passes it in the east at its northern border, and its own edges: those
    that meet its closed square (a few more may be named, none less), and upright ones where that number changes."""
    found = []
    step = max(1, _HELD // max(1, len(edges)))
    y1, x1, y2, x2 = (edges[:, i][None, :] for i in range(4))
    for k in range(0, len(south), step):
        s, w = south[k : k + step, None], west[k : k + step, None]
        n, e = s + side, w + side
        low, high = np.maximum(np.minimum(y1, y2), s), np.minimum(np.maximum(y1, y2), n)
        with np.errstate(divide="ignore", invalid="ignore"):
            ways = [(x2 - x1) * (y - y1) / (y2 - y1) + x1 for y in (low, high)]
        level = (low <= high) & (y1 != y2)
        east = level & (np.minimum(*ways) > e + _SLACK)
        near = level & ~east & (np.maximum(*ways) >= w - _SLACK)
        for i in range(len(s)):
            ends, times = np.unique(edges[east[i]][:, [0, 2]], return_counts=True)
            ends = ends[times % 2 == 1]
            within = ends[(ends > s[i]) & (ends < n[i])]
            beyond = np.count_nonzero(ends >= n[i]) % 2 == 1
            # an upright edge from an end to the north counts for points that are not south of the end, so each turns the number
            upright = np.column_stack([within, np.full(len(within), _FAR), np.full(len(within), n[i]), np.full(len(within), _FAR)])
            found.append((beyond != (len(within) % 2 == 1), np.vstack([edges[near[i]], upright])))
    return found


def cells_of(edges: np.ndarray, most_edges: int) -> Iterator[tuple[int, int, int, bool, np.ndarray]]:
    """(level, row, column, odd, edges) of the cells that a polygon meets; odd: whether a point that meets none of the edges is inside."""
    if not len(edges):
        return
    side = SIDES[0]
    ys, xs = edges[:, [0, 2]], edges[:, [1, 3]]
    rows, columns = (np.arange(int(np.floor((v.min() - slack) / side)), int(np.floor((v.max() + slack) / side)) + 1) for v, slack in ((ys, 0.0), (xs, _SLACK)))
    r, c = (m.ravel() for m in np.meshgrid(rows, columns, indexing="ij"))
    waiting = [(0, r, c, edges)]
    while waiting:
        level, r, c, own = waiting.pop()
        side = SIDES[level]
        for row, column, (odd, near) in zip(r.tolist(), c.tolist(), _parted(r * side, c * side, side, own)):
            if len(near) > most_edges and level + 1 < len(SIDES):
                i, j = (m.ravel() for m in np.meshgrid(np.arange(SPLIT), np.arange(SPLIT), indexing="ij"))
                whole = np.array([[(row + 1) * side, _FAR, row * side, _FAR]] if odd else np.empty((0, 4)))
                waiting.append((level + 1, row * SPLIT + i, column * SPLIT + j, np.vstack([near, whole])))
            elif len(near) or odd:
                yield level, row, column, odd, near


def area_cells(areas: DataFrame, names: list[str], most_edges: int = 32) -> DataFrame:
    """(level, row, column, area, inside, edges) of all areas: rings, or ring, and the columns named, which make the
    struct area. A polygon is cut up in one task, in memory bounded by its own edges."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.float64()) for n in ("y1", "x1", "y2", "x2")]))
        for batch in batches:
            for k in range(batch.num_rows):
                found = list(cells_of(edges_of(batch.column("rings")[k].as_py()), most_edges))
                if not found:
                    continue
                level, row, column, inside, edges = zip(*found)
                flat = np.concatenate(edges)
                parts = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(4)], fields=list(kind.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(e) for e in edges]), pa.int32()), parts)
                area = batch.column("area").take(pa.array([k] * len(found)))
                yield pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(row, pa.int64()), pa.array(column, pa.int64()), area, pa.array(inside), lists], ["level", "row", "column", "area", "inside", "edges"])

    rings = F.col("rings") if "rings" in areas.columns else F.array("ring")
    given = areas.select(F.struct(*names).alias("area"), rings.alias("rings"))
    kind = given.schema["area"].dataType.simpleString()
    return given.mapInArrow(cut, f"level int, row long, column long, area {kind}, inside boolean, edges {_EDGES}")


def _inside(lat: Column, lon: Column, cell: Column) -> Column:
    def crosses(e: Column) -> Column:
        at = F.try_divide((e["x2"] - e["x1"]) * (lat - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
        return F.coalesce(((e["y1"] > lat) != (e["y2"] > lat)) & (lon < at), F.lit(False))

    return cell["inside"] != (F.size(F.filter(cell["edges"], crosses)) % 2 == 1)


def with_area(points: DataFrame, areas: DataFrame, names: list[str], wanted: Column, most_edges: int = 32) -> DataFrame:
    """points with a struct _area of the least area (by names) that holds the point; null where none does or `wanted` is
    not true. A point meets its cell of each level by an equi-join; small levels are sent to all tasks."""
    index = stored(area_cells(areas, names, most_edges), "area-cells")
    sizes = index.groupBy("level").agg(F.sum(200 + 32 * F.size("edges")).alias("bytes")).collect()  # one row a level
    out, found = points, []
    for level, size in sorted((r["level"], r["bytes"]) for r in sizes):
        side = SIDES[level]
        near = index.where(F.col("level") == level).groupBy("row", "column").agg(F.collect_list(F.struct("area", "inside", "edges")).alias(f"_near{level}"))
        near = near.withColumnsRenamed({"row": f"_row{level}", "column": f"_column{level}"})
        near = F.broadcast(near) if size <= BROADCAST_BYTES else near
        own = (F.when(wanted, F.floor(F.col("lat") / side)) == F.col(f"_row{level}")) & (F.floor(F.col("lon") / side) == F.col(f"_column{level}"))
        out = out.join(near, own, "left").drop(f"_row{level}", f"_column{level}")
        hits = F.filter(f"_near{level}", lambda cell: _inside(F.col("lat"), F.col("lon"), cell))
        found.append(F.array_min(F.transform(hits, lambda c: c["area"])))
    if not found:
        return points.withColumn("_area", F.lit(None).cast(areas.select(F.struct(*names)).schema[0].dataType))
    least = F.array_min(F.array_compact(F.array(*found)))
    return out.withColumn("_area", least).drop(*(c for c in out.columns if c.startswith("_near")))
