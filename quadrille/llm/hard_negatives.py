"""Hard negatives of anchor vectors, by bounds along spanning trees of the anchors.

For an anchor ``a`` with parent ``p`` in a tree and a candidate ``c``,
``|<a,c> - <p,c>| <= |a - p| * |c|``.  A task holds one block of candidates and
one tree: scores at the root are exact, every further anchor gets an interval
per candidate from its parent, and only candidates whose interval meets the
anchor's window are scored again.  The bounds leave out nothing: a candidate
outside the interval cannot lie in the window.

Trees and blocks meet as rows of a product of two stored tables: each task
reads its part of both, nothing is repeated in a shuffle and no vector passes
the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quadrille.llm.common import col, written
from quadrille.session import shuffled

#: candidates that meet a tree at once, inside a task
CHUNK = 2048
#: products below this bound are exact in double precision
EXACT = float(2 ** 53)


@dataclass(frozen=True)
class Mining:
    """``positives`` best rows of the anchor's label; per positive ``negatives``
    best rows of other labels with a score of ``low`` to ``high`` percent of it.

    Components are floor(``scale`` * x).  ``tree_size`` anchors form a tree,
    about ``block_rows`` candidates a block: they bound what a task holds and
    change no result.
    """
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    tree_size: int = 1024
    block_rows: int = 8192


def vectors(df: DataFrame, scale: int, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, vector of whole numbers) of the rows that take part.

    Rows with a null id, label, vector or component, or a component that is not
    finite, take no part.  Of rows with one vec_id the smallest (label, vector)
    stays.
    """
    rows = df.select(col(vec_id).cast("long").alias("vec_id"), col(label).cast("long").alias("label"),
                     col(embedding).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(finite)
    rows = rows.select("vec_id", F.struct("label", F.transform("x", lambda x: F.floor(x * float(scale)).cast("double")).alias("vector")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.vector")


def _matrix(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels, and the vectors padded with zeros to the longest."""
    ids, labels = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch)
                              else batch.column(c).to_numpy(), dtype=np.int64) for c in ("vec_id", "label"))
    lists = batch.column("vector")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ends = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    out = np.zeros((len(ends), max(1, int(ends.max(initial=1)))))
    out[np.arange(out.shape[1])[None, :] < ends[:, None]] = flat
    return ids, labels, out


BLOCK = "width long, ids binary, labels binary, vectors binary"


def _blobs(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> dict:
    return {"width": [x.shape[1]], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "vectors": [x.tobytes()]}


def blocks(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` packed into ``count`` blocks by a hash of the id: (slot, width, ids, labels, vectors)."""

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, labels, x = _matrix(table)
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int64()), **_blobs(ids, labels, x)})

    slot = F.pmod(F.xxhash64("vec_id"), F.lit(count))
    return rows.withColumn("slot", slot).groupBy("slot").applyInArrow(pack, f"slot long, {BLOCK}")


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of the rows of ``x`` from row 0: order of the rows
    by depth, and in that order the parent's place, the edge and the depth."""
    n = len(x)
    best, parent = np.full(n, np.inf), np.zeros(n, np.int64)
    depth, edge, done = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
    now, left = 0, n - 1
    done[0] = True
    while left:
        gap = np.sqrt(np.square(x - x[now]).sum(axis=1))
        nearer = ~done & (gap < best)
        best[nearer], parent[nearer] = gap[nearer], now
        now = int(np.argmin(np.where(done, np.inf, best)))
        done[now], depth[now], edge[now] = True, depth[parent[now]] + 1, best[now]
        left -= 1
    order = np.argsort(depth, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place[parent[order]], edge[order], depth[order]


def trees(anchors: DataFrame, size: int) -> DataFrame:
    """Anchors in trees of at most ``size``: (tree, the blobs of a block in
    order of depth, parents, edges, depths).

    Anchors are range sorted by label and the signs of their first components,
    so that near ones mostly share a tree; any other split gives equal results.
    """

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tree() -> pa.RecordBatch:
            ids, labels, x = _matrix(pa.Table.from_batches(held))
            order, parents, edges, depths = spanning_tree(x)
            ids, labels, x = ids[order], labels[order], x[order]
            return pa.RecordBatch.from_pydict({"tree": [int(ids.min())], **_blobs(ids, labels, x), "parents": [parents.tobytes()],
                                               "edges": [edges.tobytes()], "depths": [depths.tobytes()]})

        for batch in batches:
            while batch.num_rows:
                room = size - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == size:
                    yield tree()
                    held.clear()
        if held:
            yield tree()

    signs = F.aggregate(F.slice("vector", 1, 16), F.lit(0), lambda acc, x: acc * 2 + (x >= 0).cast("int"))
    sorted_ = anchors.withColumn("_signs", signs).repartitionByRange("label", "_signs", "vec_id").sortWithinPartitions("label", "_signs", "vec_id")
    return sorted_.select("vec_id", "label", "vector").mapInArrow(grow, f"tree long, {BLOCK}, parents binary, edges binary, depths binary")


@dataclass
class Side:
    """Rows of a block or tree as arrays."""
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    lengths: np.ndarray


def _side(row: dict, prefix: str) -> Side:
    x = np.frombuffer(row[f"{prefix}vectors"], np.float64).reshape(-1, row[f"{prefix}width"])
    return Side(np.frombuffer(row[f"{prefix}ids"], np.int64), np.frombuffer(row[f"{prefix}labels"], np.int64), x,
                np.sqrt(np.square(x).sum(axis=1)))


def products(a: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Exact products of rows of whole numbers."""
    width = min(a.shape[1], c.shape[1])
    a, c = a[:, :width], c[:, :width]
    if bound >= EXACT:
        if bound >= 2.0 ** 62:
            raise OverflowError("scores beyond 64 bits")
        return a.astype(np.int64) @ c.astype(np.int64).T
    return a @ c.T


def scored(tree: Side, parents: np.ndarray, edges: np.ndarray, depths: np.ndarray, rows: Side,
           wanted: Callable[[slice, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Level by level of the tree: (anchors, scores, which were scored).

    ``wanted(anchors, low, high)`` says whose interval meets the window; the
    root's scores are all taken, as the base of the intervals.
    """
    n, m = len(tree.ids), len(rows.ids)
    bound = float(tree.lengths.max(initial=0) * rows.lengths.max(initial=0)) * (1 + 1e-9)
    low, high = np.empty((n, m)), np.empty((n, m))
    starts = np.flatnonzero(np.r_[True, depths[1:] != depths[:-1], True])
    for start, end in zip(starts[:-1], starts[1:], strict=True):
        at = slice(int(start), int(end))
        if start == 0:
            lo, hi = np.full((1, m), -np.inf), np.full((1, m), np.inf)
            mask = np.ones((1, m), bool)
        else:
            reach = edges[at, None] * rows.lengths[None, :]
            reach += 1e-6 * (1 + bound * 1e-6)       # rounding of lengths and sums
            lo, hi = low[parents[at]] - reach, high[parents[at]] + reach
            mask = wanted(at, lo, hi)
        if mask.mean() > 0.1:
            score = products(tree.x[at], rows.x, bound)
        else:
            score = np.zeros(mask.shape, np.int64 if bound >= EXACT else np.float64)
            for k in np.flatnonzero(mask.any(axis=1)):
                there = np.flatnonzero(mask[k])
                score[k, there] = products(tree.x[at][k:k + 1], rows.x[there], bound)[0]
        low[at], high[at] = np.where(mask, score, lo), np.where(mask, score, hi)
        yield at, score, mask


def _first(k: int, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the best ``k`` of each group: score descending, id ascending."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    begin = np.searchsorted(g, g, side="left")
    return order[np.arange(len(g)) - begin < k]


def _positives(tree: Side, shape: tuple, rows: Side, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, id, score): the best ``k`` rows of the anchor's label in this block."""
    out: list[tuple] = []
    for at in range(0, len(rows.ids), CHUNK):
        part = Side(rows.ids[at:at + CHUNK], rows.labels[at:at + CHUNK], rows.x[at:at + CHUNK], rows.lengths[at:at + CHUNK])
        own = (tree.labels[:, None] == part.labels[None, :]) & (tree.ids[:, None] != part.ids[None, :])

        def wanted(a: slice, low: np.ndarray, high: np.ndarray, own: np.ndarray = own) -> np.ndarray:
            if own.shape[1] <= k:
                return own[a]
            # k rows reach at least the k-th lower bound
            least = np.partition(np.where(own[a], low, -np.inf), own.shape[1] - k, axis=1)[:, own.shape[1] - k]
            return own[a] & (high >= least[:, None])

        for a, score, mask in scored(tree, *shape, part, wanted):
            r, c = np.nonzero(mask & own[a])
            keep = _first(k, r, score[r, c], part.ids[c])
            out.append((r[keep] + a.start, part.ids[c[keep]], score[r[keep], c[keep]]))
    place, ids, score = (np.concatenate(x) for x in zip(*out, strict=True))
    keep = _first(k, place, score, ids)
    return place[keep], ids[keep], score[keep]


def _negatives(tree: Side, shape: tuple, rows: Side, windows: list[list[tuple[int, int]]], mining: Mining
               ) -> tuple[np.ndarray, ...]:
    """(anchor place, positive's place in its list, id, score): the best
    ``negatives`` rows of other labels inside each window, in this block."""
    least = [[-((-mining.low * p) // 100) for _, p in w] for w in windows]
    most = [[(mining.high * p) // 100 for _, p in w] for w in windows]
    open_ = [[a <= b for a, b in zip(x, y, strict=True)] for x, y in zip(least, most, strict=True)]
    bottom = np.array([min((a for a, o in zip(x, y, strict=True) if o), default=np.inf) for x, y in zip(least, open_, strict=True)], float)
    top = np.array([max((a for a, o in zip(x, y, strict=True) if o), default=-np.inf) for x, y in zip(most, open_, strict=True)], float)
    out: list[tuple] = []
    for at in range(0, len(rows.ids), CHUNK):
        part = Side(rows.ids[at:at + CHUNK], rows.labels[at:at + CHUNK], rows.x[at:at + CHUNK], rows.lengths[at:at + CHUNK])
        other = tree.labels[:, None] != part.labels[None, :]

        def wanted(a: slice, low: np.ndarray, high: np.ndarray, other: np.ndarray = other) -> np.ndarray:
            return other[a] & (high >= bottom[a, None]) & (low <= top[a, None])

        for a, score, mask in scored(tree, *shape, part, wanted):
            r, c = np.nonzero(mask & other[a] & (score >= bottom[a, None]) & (score <= top[a, None]))
            s, ids = score[r, c], part.ids[c]
            order = np.lexsort((ids, -s, r))
            r, s, ids = r[order], s[order], ids[order]
            begins = np.searchsorted(r, np.arange(a.stop - a.start + 1))
            for k in np.flatnonzero(np.diff(begins)):
                mine, mine_ids = s[begins[k]:begins[k + 1]], ids[begins[k]:begins[k + 1]]
                for p, (lo, hi, is_open) in enumerate(zip(least[a.start + k], most[a.start + k], open_[a.start + k], strict=True)):
                    if is_open:
                        first = int(np.searchsorted(-mine, -hi))
                        best = mine[first:first + mining.negatives]
                        n = int((best >= lo).sum())
                        out.append((np.full(n, a.start + k), np.full(n, p), mine_ids[first:first + n], best[:n]))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    place, positive, ids, score = (np.concatenate(x) for x in zip(*out, strict=True))
    keep = _first(mining.negatives, place * (mining.positives + 1) + positive, score, ids)
    return place[keep], positive[keep], ids[keep], score[keep]


def _shape(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["parents"], np.int64), np.frombuffer(row["edges"], np.float64), np.frombuffer(row["depths"], np.int64)


def _met(grown: DataFrame, packed: DataFrame) -> DataFrame:
    """Each tree beside each block, a task for each two partitions.

    The planner knows only the compressed files, so it may send vectors to all
    tasks through the driver unless told otherwise.
    """
    there = packed.select(*[F.col(c).alias(f"c_{c}") for c in ("width", "ids", "labels", "vectors")])
    return there.crossJoin(grown.hint("shuffle_replicate_nl"))


def _longs(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.asarray(a).astype(np.int64)) for a in arrays]


def mined(df: DataFrame, is_anchor: Column, mining: Mining = Mining(), vec_id: str = "vec_id", embedding: str = "embedding",
          label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``vec_id``.  Scores are exact whole numbers,
    higher first, ties by smaller id; an anchor without another row of its
    label, or without a row in a window, gives nothing.  Vectors of different
    lengths are read as padded with zeros.  Repeated ids count once, see
    ``vectors``; scores beyond 64 bits are an error.  An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = vectors(df, mining.scale, vec_id, embedding, label)
    count = max(1, -(-df.count() // mining.block_rows))
    packed = written(blocks(rows, count), "negatives-blocks")
    grown = written(trees(rows.filter(is_anchor), mining.tree_size), "negatives-trees")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = _side(row, "")
                place, ids, score = _positives(tree, _shape(row), _side(row, "c_"), mining.positives)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["tree"])), *_longs(tree.ids[place], ids, score)],
                                                 ["tree", "anchor_id", "positive_id", "positive_score"])

    best = _met(grown, packed).mapInArrow(near, "tree long, anchor_id long, positive_id long, positive_score long")
    order = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = written(best.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= mining.positives).drop("_rank"),
                   "negatives-positives")
    # at most tree_size anchors with their few positives a tree
    windows = best.groupBy("tree", "anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("list"))
    windows = windows.groupBy("tree").agg(F.collect_list(F.struct("anchor_id", "list")).alias("windows"))
    asking = written(grown.join(shuffled(windows), "tree"), "negatives-windows")

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = _side(row, "")
                own = {w["anchor_id"]: [(p["positive_id"], p["positive_score"]) for p in w["list"]] for w in row["windows"]}
                lists = [own.get(i, []) for i in tree.ids.tolist()]
                place, positive, ids, score = _negatives(tree, _shape(row), _side(row, "c_"), lists, mining)
                pairs = [lists[a][p] for a, p in zip(place.tolist(), positive.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    _longs(tree.ids[place], np.array([p for p, _ in pairs], np.int64), np.array([s for _, s in pairs], np.int64), ids, score),
                    ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    found = _met(asking, packed).mapInArrow(
        far, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= mining.negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
