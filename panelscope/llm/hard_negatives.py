"""Hard-negative mining with cover trees over norm-augmented vectors.

Candidates become points of one sphere by one component more,
``sqrt(M**2 - |x|**2)``, M the largest norm; a query gets 0 there, so that
inner products stay what they were and angles bound them: under a node with
centre c whose points lie within the covering radius r, the angle to a query
differs from that of c by at most ``2 * asin(r / 2M)``.

All rows are dealt to blocks of bounded size: by the nearest of a few centres,
chosen far from each other in a bounded sample, and large cells by row number
too. Each block's task builds a cover tree: a node's children are centres
farthest from each other until every point is within half the node's radius
(or the node has its number of children), its own centre first; nodes with few
points or radius 0 are leaves. The tree's nodes and the points with their leaf
are rows of the index table.

Anchors meet blocks in groups of bounded size (anchor groups x blocks, never
single pairs). In such a meeting bounds are computed level by level for all
anchors; then each anchor takes its leaves in the order of their upper bounds,
skips those outside its windows, computes exact scores of the rest, and stops
where no leaf can bring better ones. Positives come first (their search starts
with the score that the anchor's own block guarantees), then the windows that
they span.

Defined results: vectors shorter than others count as padded with zeros; a null
id is larger than any other in ties and no anchor; a repeated row is a row of
its own, as anchor, positive and negative; an anchor without positives, and a
positive without negatives in its window, give no rows; an empty table gives
none; other columns are ignored. Scores are exact; one that doesn't fit a long
makes the query fail.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelscope.llm.layout import cut

SCALE = 256
ANCHOR_EVERY = 50
MOVED_EVERY = 7
LABELS = 10
POSITIVES = 5
NEGATIVES = 3
#: A negative's score is within these shares (%) of the positive's.
WINDOW_PCT = (50, 95)
#: Rows of a block and anchors of a group (about), cells at most, rows of the sample that gives their centres.
BLOCK_ROWS = 8_192
GROUP_ANCHORS = 8_192
MAX_CELLS = 256
SAMPLE_ROWS = 4_096
LEAF_ROWS = 32
MAX_CHILDREN = 64
#: Anchors that descend together, and points scored at once.
BATCH_ANCHORS = 64
STEP_ROWS = 512

_NO_ID = np.iinfo(np.int64).max
_NONE = -_NO_ID  # no score; scores are above this
_ROWS = "block int, row long, id long, label long, vec array<double>"
_INDEX = _ROWS + ", node int, parent int, radius double, least double"


# --- vectors ------------------------------------------------------------------

def usable_rows(embeddings: DataFrame) -> DataFrame:
    """row (number), id, label, vec of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    moved = F.coalesce(F.col("vec_id") % F.lit(MOVED_EVERY) == 0, F.lit(False))
    given = F.col("label").cast("long")
    label = F.when(moved, (given + F.lit(1)) % F.lit(LABELS)).otherwise(given)
    vec = F.transform(x, lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")).cast("double"))
    return embeddings.filter(F.col("label").isNotNull() & x.isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID)).alias("id"), label.alias("label"),
        vec.alias("vec"))


def is_anchor(every: int = ANCHOR_EVERY) -> Column:
    return (F.col("id") % F.lit(every) == 0) & (F.col("id") != F.lit(_NO_ID))


def matrix(column: pa.ChunkedArray | pa.Array, dims: int = 0) -> np.ndarray:
    """Vectors as rows, padded with zeros to the longest (at least ``dims``)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    wide = max(dims, int(size.max(initial=0)))
    if len(size) and size.min() == wide:
        return values.reshape(len(size), wide)
    out = np.zeros((len(size), wide))
    out[np.arange(wide)[None, :] < size[:, None]] = values
    return out


def widened(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] >= dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``q`` with those of ``x``, as long."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, q.shape[1]) < 2.0 ** 53:
        return (q @ x.T).astype(np.int64)
    a, b = ([[int(v) for v in row] for row in m] for m in (q, x))
    return np.array([[sum(map(int.__mul__, u, v)) for v in b] for u in a], dtype=np.int64).reshape(len(a), len(b))


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def augmented(x: np.ndarray, size: float) -> np.ndarray:
    """One component more, so that every row has the norm ``size``."""
    rest = np.sqrt(np.maximum(size * size - (x * x).sum(1), 0.0))
    return np.concatenate([x, rest[:, None]], axis=1)


# --- cover tree -----------------------------------------------------------------

@dataclass
class Tree:
    """Nodes in order of their levels: parent (-1: root), row of the centre,
    covering radius; ``leaf`` is the leaf of each row."""
    parent: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    leaf: np.ndarray


def cover_tree(points: np.ndarray, leaf_rows: int = LEAF_ROWS, max_children: int = MAX_CHILDREN) -> Tree:
    parent, centre, radius = [-1], [0], [float(_far(points, points[0]).max())]
    leaf = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))]
    while todo:
        later = []
        for node, rows in todo:
            leaf[rows] = node
            if len(rows) <= leaf_rows or radius[node] == 0.0:
                continue
            members = points[rows]
            most = min(max_children, -(-len(rows) // leaf_rows))
            centres, near = [centre[node]], np.zeros(len(rows), np.int64)
            gap = _far(members, points[centre[node]])
            while len(centres) < most and gap.max() > radius[node] / 2:
                new = rows[int(gap.argmax())]
                d = _far(members, points[new])
                near[d < gap] = len(centres)
                gap = np.minimum(gap, d)
                centres.append(int(new))
            for k, c in enumerate(centres):
                own = near == k
                if len(centres) == 1 or not own.any():
                    continue
                parent.append(node)
                centre.append(c)
                radius.append(float(gap[own].max()))
                later.append((len(parent) - 1, rows[own]))
        todo = later
    return Tree(np.array(parent), np.array(centre), np.array(radius), leaf)


def _far(points: np.ndarray, from_: np.ndarray) -> np.ndarray:
    d = points - from_
    return np.sqrt((d * d).sum(1))


def bounds(cos: np.ndarray, radius: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest cosine to a query under nodes of these radii, from
    the cosines of their centres."""
    turn = 1.0 - radius * radius / (2.0 * size * size)  # cosine of the angle that the radius spans
    cross = np.sqrt(np.maximum(1 - cos * cos, 0.0)) * np.sqrt(np.maximum(1 - turn * turn, 0.0))
    high = np.where(turn <= cos, 1.0, cos * turn + cross)
    low = np.where(turn <= -cos, -1.0, cos * turn - cross)
    return low, high


# --- a block and its anchors (inside tasks) ----------------------------------------

@dataclass
class Block:
    """Points of a block ordered by leaf, and its tree."""
    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    size: float
    centre: np.ndarray   # of each node
    parent: np.ndarray
    radius: np.ndarray
    leaves: np.ndarray   # nodes that hold points
    edge: np.ndarray     # first point of each leaf, and the end

    def leaf_bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores (queries x leaves), level by level: a node's
        bounds are never wider than its parent's."""
        length = np.maximum(norms(q), 1.0)[:, None]
        cos = np.clip((q @ self.centre.T) / (length * self.size), -1.0, 1.0)
        low, high = bounds(cos, self.radius[None, :], self.size)
        for node in range(1, len(self.parent)):  # parents come first
            up = self.parent[node]
            np.maximum(low[:, node], low[:, up], out=low[:, node])
            np.minimum(high[:, node], high[:, up], out=high[:, node])
        slack = 1e-6 * (length * self.size + 1)  # more than rounding can do
        return ((low * length * self.size - slack)[:, self.leaves],
                (high * length * self.size + slack)[:, self.leaves])


def _block(table: pa.Table, dims: int = 0) -> Block:
    node_row = np.asarray(table.column("row").is_null())
    points = table.filter(pa.array(~node_row))
    nodes = table.filter(pa.array(node_row)).sort_by("node")
    points = points.sort_by([("node", "ascending"), ("row", "ascending")])
    x = matrix(points.column("vec"), dims)
    leaf = points.column("node").to_numpy()
    leaves, edge = np.unique(leaf, return_index=True)
    return Block(
        points.column("row").to_numpy(), points.column("id").to_numpy(), points.column("label").to_numpy(), x,
        max(float(norms(x).max(initial=0)), 1.0), widened(matrix(nodes.column("vec")), x.shape[1]),
        nodes.column("parent").to_numpy(), nodes.column("radius").to_numpy(), leaves, np.append(edge, len(leaf)))


@dataclass
class Asked:
    """Searches of some anchors: the first points by score within a window
    each, an anchor having one or more of them."""
    row: np.ndarray      # of each anchor
    label: np.ndarray
    q: np.ndarray
    anchor: np.ndarray   # of each search
    least: np.ndarray
    most: np.ndarray
    alike: bool          # points of the anchor's label, or of others

    def batches(self, block: Block) -> Iterator[tuple[Asked, np.ndarray]]:
        """Searches of at most ``BATCH_ANCHORS`` anchors that lie near the same
        leaf, with their numbers."""
        near = (self.q @ block.centre[block.leaves].T).argmax(1)
        order = np.argsort(near, kind="stable")
        for at in range(0, len(order), BATCH_ANCHORS):
            part = order[at:at + BATCH_ANCHORS]
            place = np.full(len(self.q), -1)
            place[part] = np.arange(len(part))
            own = np.flatnonzero(place[self.anchor] >= 0)
            yield Asked(self.row[part], self.label[part], self.q[part], place[self.anchor[own]], self.least[own],
                        self.most[own], self.alike), own


def descended(block: Block, asked: Asked, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Search, score and id of the first ``k`` points of each search, by
    (score descending, id)."""
    out = []
    for part, number in asked.batches(block):
        score, id_ = _best_first(block, part, k)
        search, place = np.nonzero(score != _NONE)
        out.append((number[search], score[search, place], id_[search, place]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _best_first(block: Block, asked: Asked, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves in the order of their upper bounds, about ``STEP_ROWS`` points at
    once; a leaf outside all windows, which rise as points are found, is skipped."""
    n = len(asked.anchor)
    score, id_ = np.full((n, k), _NONE), np.full((n, k), _NO_ID)
    floor = asked.least.copy()
    low, high = block.leaf_bounds(asked.q)
    low, high = low[asked.anchor], high[asked.anchor]

    def useful(leaves: np.ndarray) -> np.ndarray:
        return ((high[:, leaves] >= floor[:, None]) & (low[:, leaves] <= asked.most[:, None])).any(0)

    order = np.flatnonzero(useful(np.arange(len(block.leaves))))
    order = order[np.argsort(-high[:, order].max(0), kind="stable")]
    sizes = np.diff(block.edge)
    while len(order):
        to = int(np.searchsorted(np.cumsum(sizes[order]), STEP_ROWS)) + 1
        part, order = order[:to], order[to:]
        rows = np.concatenate([np.arange(block.edge[i], block.edge[i + 1]) for i in part])
        found = scores(block.x[rows], asked.q)
        other = block.label[rows][None, :] != asked.label[:, None]
        allowed = ~other & (block.row[rows][None, :] != asked.row[:, None]) if asked.alike else other
        found = np.where(allowed, found, _NONE)[asked.anchor]
        search, at = np.nonzero((found >= floor[:, None]) & (found <= asked.most[:, None]) & (found != _NONE))
        if len(search):
            # the k first of what was there and what is new; every search has k entries already
            who = np.concatenate([search, np.repeat(np.arange(n), k)])
            s = np.concatenate([found[search, at], score.ravel()])
            i = np.concatenate([block.id[rows[at]], id_.ravel()])
            by = np.lexsort((i, -s, who))
            first = np.searchsorted(who[by], np.arange(n))[:, None] + np.arange(k)[None, :]
            score, id_ = s[by][first], i[by][first]
            floor = np.maximum(floor, score[:, -1])
        order = order[useful(order)]
    return score, id_


def _for_positives(row: np.ndarray, label: np.ndarray, q: np.ndarray, least: np.ndarray) -> Asked:
    """One search an anchor among its label, for scores of ``least`` (if known) at least."""
    floor = np.where(np.isnan(least), float(_NONE // 2), least).astype(np.int64)
    return Asked(row, label, q, np.arange(len(q)), floor, np.full(len(q), _NO_ID), True)


# --- Spark steps --------------------------------------------------------------------

def far_centres(rows: DataFrame, n: int, cells: int, sample_rows: int) -> np.ndarray:
    """Centres of the cells: rows of a bounded sample, each far from those before."""
    share = min(1.0, sample_rows / max(n, 1))
    x = matrix(rows.select("vec").sample(share, seed=12).limit(2 * sample_rows).toArrow().column("vec"))
    if not len(x):
        return np.zeros((1, 0))
    chosen, gap = [0], _far(x, x[0])
    while len(chosen) < cells and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _far(x, x[chosen[-1]]))
    return x[chosen]


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS, max_cells: int = MAX_CELLS,
           sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, int]:
    """``rows`` with their block, and the number of blocks."""
    n = rows.count()
    centres = far_centres(rows, n, max(1, min(max_cells, -(-n // block_rows))), sample_rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = matrix(batch.column("vec"), centres.shape[1])
                c = widened(centres, x.shape[1])
                cell = ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns],
                                                 names=["block", *batch.schema.names])

    placed = cut(rows.mapInArrow(place, _ROWS))
    # a row a cell, max_cells at most
    sizes = {r["block"]: r["n"] for r in placed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [max(1, -(-sizes.get(c, 0) // block_rows)) for c in range(len(centres))]
    first = [sum(parts[:c]) for c in range(len(parts))]
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("block") + 1)
    dealt = at(first) + F.pmod(F.xxhash64("row"), at(parts)).cast("int")
    return placed.withColumn("block", dealt.cast("int")), sum(parts)


def index(placed: DataFrame, positives: int = POSITIVES, anchor_every: int = ANCHOR_EVERY) -> DataFrame:
    """Points (with ``row``) and tree nodes (without) of every block; ``least``
    is what an anchor's own block guarantees its last positive to score."""
    def build(table: pa.Table) -> pa.Table:
        x = matrix(table.column("vec"))
        row, id_, label = (table.column(c).to_numpy() for c in ("row", "id", "label"))
        size = max(float(norms(x).max(initial=0)), 1.0)
        tree = cover_tree(augmented(x, size))
        order = np.argsort(tree.leaf, kind="stable")
        leaves, edge = np.unique(tree.leaf[order], return_index=True)
        own = Block(row[order], id_[order], label[order], x[order], size, x[tree.centre],
                    tree.parent, tree.radius, leaves, np.append(edge, len(order)))
        least = np.full(len(x), np.nan)
        asked = np.flatnonzero((id_ % anchor_every == 0) & (id_ != _NO_ID))
        search, score, _ = descended(own, _for_positives(row[asked], label[asked], x[asked], least[asked]), positives)
        full, last = np.bincount(search, minlength=len(asked)) == positives, np.full(len(asked), _NO_ID)
        np.minimum.at(last, search, score)
        least[asked[full]] = last[full]
        m, block = len(tree.parent), table.column("block")[0].as_py()
        vec = table.column("vec").combine_chunks()
        empty = lambda kind: pa.nulls(m, kind)
        return pa.table({
            "block": pa.array(np.full(len(x) + m, block, np.int32)),
            "row": pa.concat_arrays([pa.array(row), empty(pa.int64())]),
            "id": pa.concat_arrays([pa.array(id_), empty(pa.int64())]),
            "label": pa.concat_arrays([pa.array(label), empty(pa.int64())]),
            "vec": pa.concat_arrays([vec, vec.take(pa.array(tree.centre))]),
            "node": pa.array(np.concatenate([tree.leaf, np.arange(m)]).astype(np.int32)),
            "parent": pa.concat_arrays([pa.nulls(len(x), pa.int32()), pa.array(tree.parent.astype(np.int32))]),
            "radius": pa.concat_arrays([pa.nulls(len(x), pa.float64()), pa.array(tree.radius)]),
            "least": pa.concat_arrays([pa.array(least, from_pandas=True), empty(pa.float64())])})

    return cut(placed.groupBy("block").applyInArrow(build, _INDEX))


def _meet(indexed: DataFrame, n_blocks: int, anchors: DataFrame, group_anchors: int, run, schema: str) -> DataFrame:
    """``run`` for every block with every group of anchors."""
    groups = max(1, -(-anchors.count() // group_anchors))
    to_blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    left = indexed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = anchors.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int")) \
        .withColumn("block", to_blocks)
    return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(run, schema)


def mined(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
          window_pct: tuple[int, int] = WINDOW_PCT, anchor_every: int = ANCHOR_EVERY,
          block_rows: int = BLOCK_ROWS, group_anchors: int = GROUP_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = cut(usable_rows(embeddings))
    placed, n_blocks = blocks(rows, block_rows)
    indexed = index(placed, positives, anchor_every)
    anchors = indexed.filter("row is not null").filter(is_anchor(anchor_every)).select(
        F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "label", "vec", "least")

    def find_positives(block: pa.Table, asked: pa.Table) -> pa.Table:
        search, score, id_ = (np.zeros(0, np.int64),) * 3
        row = asked.column("anchor").to_numpy()
        if len(block) and len(asked):
            q = matrix(asked.column("vec"))
            b = _block(block, q.shape[1])
            search, score, id_ = descended(b, _for_positives(
                row, asked.column("label").to_numpy(), widened(q, b.x.shape[1]), asked.column("least").to_numpy()),
                positives)
        return pa.table({"anchor": row[search], "score": score, "id": id_})

    near = _meet(indexed, n_blocks, anchors, group_anchors, find_positives, "anchor long, score long, id long")
    by_score = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    chosen = near.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= positives)
    # at most ``positives`` entries in a list
    lists = chosen.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "score", "id"))).alias("p"))
    asking = cut(anchors.drop("least").join(lists, "anchor"))

    def find_negatives(block: pa.Table, asked: pa.Table) -> pa.Table:
        search, score, id_ = (np.zeros(0, np.int64),) * 3
        row, given = asked.column("anchor").to_numpy(), asked.column("p").to_pylist()
        anchor = np.repeat(np.arange(len(given)), np.array([len(p) for p in given], np.int64))
        place, of = (np.array([e[c] for p in given for e in p], np.int64) for c in ("place", "score"))
        if len(block) and len(asked):
            q = matrix(asked.column("vec"))
            b = _block(block, q.shape[1])
            least, most = -(-window_pct[0] * of // 100), window_pct[1] * of // 100
            search, score, id_ = descended(b, Asked(
                row, asked.column("label").to_numpy(), widened(q, b.x.shape[1]), anchor, least, most, False), negatives)
        return pa.table({"anchor": row[anchor[search]], "place": place[search].astype(np.int32),
                         "negative_score": score, "id": id_})

    far = _meet(indexed, n_blocks, asking, group_anchors, find_negatives,
                "anchor long, place int, negative_score long, id long")
    by_rank = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "id")
    best = far.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= negatives)
    known = lambda c: F.when(F.col(c) != F.lit(_NO_ID), F.col(c))
    pairs = asking.select("anchor", "anchor_id", F.explode("p").alias("e")).select(
        "anchor", "anchor_id", F.col("e.place").alias("place"), F.col("e.id").alias("positive"),
        F.col("e.score").alias("positive_score"))
    return best.join(pairs, ["anchor", "place"]).select(
        "anchor_id", known("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        known("id").alias("negative_id"), "positive_score", "negative_score")
