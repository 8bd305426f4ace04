"""Exact top-k search by inner product over integer vectors, with a KD-tree per shard.

A bounded sample gives the top of one tree: median splits of the widest coordinate into up to MOST_CELLS cells, which only
decide where a row goes. A cell's rows are dealt to shards of bounded size, and each shard's tree goes on splitting at
medians, with tight bounding boxes. A query visits leaves best first, by the largest inner product that the box allows, and
stops at the first box that cannot reach its k-th score. That score travels: each block of queries searches a shard of its
own cell first, and what it finds there bounds its search of all others; queries go only to cells whose tight box their
bound lets reach. Boxes that tie with the k-th score are visited, so that ties go to the smaller vec_id.

A shard's tree goes to a task once for each TASK_BLOCKS blocks of queries, which stream past it; so what is shuffled are
the vectors and, for each shard that a query may need, the query.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinsmith.llm.common import materialize, require

SCALE, QUERY_EVERY, TOP = 64, 20, 20
SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES = 8192, 256, 512
#: Cells that the sample is split into, rows of the sample, and blocks of queries that share one copy of a tree.
MOST_CELLS, SAMPLE_ROWS, TASK_BLOCKS = 1024, 16_384, 32


class Tree:
    """Leaves of a KD-tree: their rows in order, and tight boxes of all nodes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order, self.nodes = np.arange(len(ids)), []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            part = vectors[order[lo:hi]]
            low, high = part.min(0), part.max(0)
            at = len(self.nodes)
            self.nodes.append([low, high, lo, hi, -1, -1])
            if parent >= 0:
                self.nodes[parent][4 + side] = at
            widest = int((high - low).argmax())
            if hi - lo > LEAF_ROWS and high[widest] > low[widest]:
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(part[:, widest], mid)]
                stack += [(lo, lo + mid, at, 0), (lo + mid, hi, at, 1)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high = np.array([n[0] for n in self.nodes]), np.array([n[1] for n in self.nodes])
        self.nodes = [tuple(n[2:]) for n in self.nodes]

    def search(self, queries: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query up to k (score, -vec_id) of at least its bound, without its own vec_id, best first."""
        queries, vectors = _same(queries, self.vectors)
        reach = np.maximum(queries, 0) @ self.high.T.astype(queries.dtype) + np.minimum(queries, 0) @ self.low.T.astype(queries.dtype)
        out = []
        for q, me, least, up in zip(queries, own.tolist(), bound.tolist(), reach.tolist(), strict=True):
            best: list[tuple[int, int]] = []
            heap = [(-up[0], 0)]
            while heap and -heap[0][0] >= least:
                _, at = heapq.heappop(heap)
                lo, hi, left, right = self.nodes[at]
                if left >= 0:
                    heapq.heappush(heap, (-up[left], left))
                    heapq.heappush(heap, (-up[right], right))
                    continue
                scores, ids = vectors[lo:hi] @ q, self.ids[lo:hi]
                some = np.flatnonzero((scores >= least) & (ids != me))
                if len(some) > k:  # ties with the k-th of these stay
                    some = some[np.lexsort((ids[some], -scores[some]))[:k]]
                if len(some):
                    best = heapq.nlargest(k, best + [(int(s), -int(i)) for s, i in zip(scores[some], ids[some], strict=True)])
                    if len(best) == k:
                        least = max(least, best[-1][0])
            out.append(best)
        return out


def _numbers(x: np.ndarray) -> np.ndarray:
    """Vectors in the narrowest type in which inner products are exact."""
    most = float(np.abs(x).max(initial=0)) ** 2 * max(1, x.shape[1])
    return x.astype(np.float32) if most < 2**24 else x.astype(np.float64) if most < 2**53 else x


def _same(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which their inner products are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return a.astype(kind), b.astype(kind)


class Cells:
    """The top of the tree: where a row goes."""

    def __init__(self, sample: np.ndarray, cells: int):
        # (coordinate, median, left, right) of a split, or its cell alone
        self.nodes: list[tuple[int, ...]] = []
        self.n = 0
        stack = [(np.arange(len(sample)), cells, -1, 0)]
        while stack:
            rows, most, parent, side = stack.pop()
            at = len(self.nodes)
            if parent >= 0:
                d, m, *ends = self.nodes[parent]
                ends[side] = at
                self.nodes[parent] = (d, m, *ends)
            part = sample[rows]
            widest = int((part.max(0) - part.min(0)).argmax()) if len(rows) else 0
            low = part[:, widest] <= (middle := int(np.median(part[:, widest]))) if len(rows) > 1 and most > 1 else np.ones(len(rows), bool)
            if low.all():
                self.nodes.append((self.n,))
                self.n += 1
                continue
            self.nodes.append((widest, middle, -1, -1))
            stack += [(rows[low], most // 2, at, 0), (rows[~low], most - most // 2, at, 1)]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int32)
        stack = [(0, np.arange(len(vectors)))]
        while stack:
            at, rows = stack.pop()
            node = self.nodes[at]
            if len(node) == 1:
                out[rows] = node[0]
            elif len(rows):
                low = vectors[rows, node[0]] <= node[1]
                stack += [(node[2], rows[low]), (node[3], rows[~low])]
        return out


def _lists(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of a column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def _placed(cells: Cells, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cells.of(_lists(batch.column("v"), dims)))], ["vec_id", "v", "cell"])

    return run


def _build(dims: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree = Tree(table.column("vec_id").to_numpy(), _numbers(_lists(table.column("v"), dims)))
        box = [[int(x) for x in end] for end in (tree.low[0], tree.high[0])]
        return pa.table({"cell": [key[0].as_py()], "shard": [key[1].as_py()], "low": [box[0]], "high": [box[1]], "packed": [pickle.dumps(tree)]}, _schema("cell int, shard int, low long*, high long*, packed binary"))

    return run


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "long*": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in text.split(", "))])


def _block(dims: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bound = table.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)  # null is NaN
        bound = np.where(np.abs(bound) >= 2**53, np.nextafter(bound, -np.inf), bound)  # rounded, but never up
        packed = pickle.dumps((table.column("vec_id").to_numpy(), _numbers(_lists(table.column("v"), dims)), np.where(np.isnan(bound), -np.inf, bound)))
        return pa.table({"cell": [key[0].as_py()], "block": [key[1].as_py()], "packed": [packed]}, _schema("cell int, block int, packed binary"))

    return run


def _aimed(boxes: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Of each block, for each cell the queries whose bound its box can reach."""
    ids = sorted(boxes)
    low, high = (np.array([boxes[c][side] for c in ids]) for side in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, block, packed in zip(*(batch.column(c).to_pylist() for c in ("cell", "block", "packed")), strict=True):
                own, q, bound = pickle.loads(packed)
                up, left = _same(np.maximum(q, 0), high.T)
                down, right = _same(np.minimum(q, 0), low.T)
                reach = up @ left + down @ right >= bound[:, None]
                for i in np.flatnonzero(reach.any(0)).tolist():
                    some = reach[:, i]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((home, pa.int32()), (block, pa.int32()), (ids[i], pa.int32()), (pickle.dumps((own[some], q[some], bound[some])), pa.binary()))], ["home", "block", "cell", "packed"])

    return run


def _searches(k: int):
    """Rows are in order: a shard's tree, then the blocks of queries that search it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree | None = None
        for batch in batches:
            for is_tree, packed in zip(batch.column("is_tree").to_pylist(), batch.column("packed"), strict=True):
                if is_tree:
                    tree = pickle.loads(packed.as_py())
                    continue
                own, q, bound = pickle.loads(packed.as_py())
                rows = [(int(o), -i, s) for o, best in zip(own, tree.search(q, own, bound, k), strict=True) for s, i in best]
                cols = list(zip(*rows, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return run


def _answers(trees: DataFrame, blocks: DataFrame, copies: int, k: int) -> DataFrame:
    """blocks(cell, shard, block, packed) meet trees(cell, shard, packed): each task gets a tree and streams blocks past it."""
    tree = trees.select("cell", "shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(True).alias("is_tree"), "packed")
    query = blocks.select("cell", "shard", F.pmod("block", F.lit(copies)).cast("int").alias("copy"), F.lit(False).alias("is_tree"), "packed")
    both = tree.unionByName(query).repartition("cell", "shard", "copy").sortWithinPartitions("cell", "shard", "copy", F.desc("is_tree"))
    return both.select("is_tree", "packed").mapInArrow(_searches(k), "query_id long, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = TOP, query_every: int = QUERY_EVERY, scale: int = SCALE) -> DataFrame:
    """vectors(vec_id, embedding) -> (query_id, rank, vec_id, score), exact.

    Components become floor(scale * x) with x as double. Queries are the rows with vec_id divisible by query_every;
    candidates are all rows of other vec_ids with as many components. Vectors that are null or empty, hold a null or a
    component that isn't finite, or have no vec_id take no part. Of rows that repeat a vec_id one of each different vector
    takes part. Other columns are ignored; an empty table gives no rows. Scores have to fit 64 bits.
    """
    require(vectors, "vec_id", "embedding")
    x = F.col("embedding")
    # in ANSI mode a comparison with NaN is well defined: NaN is larger than infinity
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    whole = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"), F.size("embedding").alias("dims"))
    whole = materialize(whole.distinct(), "vectors")
    counts = {r["dims"]: r["n"] for r in whole.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = None
    for dims, n in sorted(counts.items()):  # one for each length of vectors that occurs, nearly always one
        here = whole.where(F.col("dims") == dims).select("vec_id", "v")
        sample = here.where(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 << 20)) <= F.lit(int(2 * SAMPLE_ROWS / n * (1 << 20)))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toArrow()
        cells = Cells(_lists(sample.column("v"), dims), min(MOST_CELLS, math.ceil(n / SHARD_ROWS)))
        placed = materialize(here.mapInArrow(_placed(cells, dims), "vec_id long, v array<long>, cell int"), "placed")
        # at most MOST_CELLS rows: how many shards and blocks of queries each cell has
        is_query = F.pmod("vec_id", F.lit(query_every)) == 0
        sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("shards"), F.greatest(F.ceil(F.count_if(is_query) / BLOCK_QUERIES), F.lit(1)).cast("int").alias("blocks"))
        sizes = materialize(sizes, "sizes")
        blocks = sizes.agg(F.sum("blocks")).first()[0]
        dealt = placed.join(F.broadcast(sizes), "cell")
        trees = dealt.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.col("shards")).cast("int")).groupBy("cell", "shard").applyInArrow(_build(dims), "cell int, shard int, low array<long>, high array<long>, packed binary")
        trees = materialize(trees, "trees")
        boxes = _boxes(trees)
        queries = dealt.where(is_query).select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int").alias("block"))
        bundle = lambda q, d=dims: q.groupBy("cell", "block").applyInArrow(_block(d), "cell int, block int, packed binary")
        home = F.pmod("block", F.col("shards")).cast("int")
        own = bundle(queries.withColumn("bound", F.lit(None).cast("long"))).join(F.broadcast(sizes.select("cell", "shards")), "cell").withColumn("shard", home)
        copies = max(1, math.ceil(blocks / TASK_BLOCKS))
        first = materialize(_answers(trees, own, copies, k), "first")
        kth = _top(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
        rest = bundle(queries.join(kth, "vec_id", "left")).mapInArrow(_aimed(boxes), "home int, block int, cell int, packed binary")
        rest = rest.join(F.broadcast(sizes.select("cell", "shards")), "cell").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        searched = rest.join(F.broadcast(sizes.select(F.col("cell").alias("home"), F.col("shards").alias("home_shards"))), "home")
        rest = searched.where((F.col("cell") != F.col("home")) | (F.col("shard") != F.pmod("block", F.col("home_shards"))))
        found = first.unionByName(_answers(trees, rest, copies, k))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = whole.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    return _top(out.distinct(), k).select("query_id", "rank", "vec_id", "score")


def _boxes(trees: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The tight box of each cell, MOST_CELLS at most."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low, high = (np.array(table.column(c).to_pylist()) for c in ("low", "high"))
        return pa.table({"cell": [key[0].as_py()], "low": [low.min(0).tolist()], "high": [high.max(0).tolist()]}, _schema("cell int, low long*, high long*"))

    rows = trees.select("cell", "low", "high").groupBy("cell").applyInArrow(run, "cell int, low array<long>, high array<long>").collect()
    return {r["cell"]: (np.array(r["low"], np.int64), np.array(r["high"], np.int64)) for r in rows}
