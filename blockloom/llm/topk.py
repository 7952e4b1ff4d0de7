"""Exact top-k search by inner product over KD-trees, one tree per shard."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, scratch, stored

#: Vectors of a shard, of a cell of shards, of a block of queries and of a leaf; boxes that a block of queries meets at a time.
SHARD, CELL, BLOCK, LEAF, BOXES = 4096, 16384, 4096, 64, 4096
#: Vectors of each width by which cells are laid out; every vector is dealt to one.
SAMPLE = 4096
#: Bytes of vectors of a cell and of a block at most, where vectors are so wide that fewer fit.
BYTES = 64 << 20
#: Products of this size and less are summed exactly in doubles.
EXACT = 1 << 53


class Tree:
    """A KD-tree over whole-number vectors: median splits of the widest side, tight boxes around every node."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF) -> None:
        self.vectors, self.low, self.high, self.parts = vectors, [], [], []
        open_ = [np.arange(len(vectors))]
        while len(self.low) < len(open_):
            ids = open_[len(self.low)]
            own = vectors[ids]
            low, high = own.min(0), own.max(0)
            self.low.append(low)
            self.high.append(high)
            width = high.astype(np.float64) - low
            axis = int(width.argmax()) if width.size else 0
            if len(ids) <= leaf or not width.size or width[axis] == 0:
                self.parts.append((ids, None))
                continue
            order = ids[np.argsort(own[:, axis], kind="stable")]
            self.parts.append((None, len(open_)))
            open_ += [order[: len(ids) // 2], order[len(ids) // 2 :]]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, the greatest inner product that a vector in the node's box can have."""
        q = queries.astype(np.float64)
        return np.maximum(q, 0) @ self.high.T.astype(np.float64) + np.minimum(q, 0) @ self.low.T.astype(np.float64)


def products(vectors: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64) if exact else vectors @ query


class Best:
    """The best k candidates of one query: a heap of (score, -id order), worst first; none below the floor is looked at."""

    def __init__(self, k: int, floor: float = -np.inf) -> None:
        self.k, self.heap, self.floor = k, [], floor

    def kth(self) -> float:
        return max(self.floor, self.heap[0][0]) if len(self.heap) == self.k else self.floor

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: int) -> None:
        some = np.flatnonzero((scores >= self.kth()) & (rows != own))
        if len(some) > self.k:
            some = some[np.lexsort((ids[some], -scores[some]))[: self.k]]
        for s, i, r in zip(scores[some].tolist(), ids[some].tolist(), rows[some].tolist()):
            heapq.heappush(self.heap, (s, -i, -r))
            if len(self.heap) > self.k:
                heapq.heappop(self.heap)


def search(best: list[Best], queries: np.ndarray, own: np.ndarray, tree: Tree, ids: np.ndarray, rows: np.ndarray) -> None:
    """Best-first traversal of one shard's tree for each query; the kth score so far comes along from earlier shards."""
    if not queries.shape[1]:
        exact = True
    else:
        most = int(np.abs(queries).max()) * int(max(np.abs(tree.low).max(), np.abs(tree.high).max())) * queries.shape[1]
        exact = most <= EXACT
    slack = 0 if exact else abs(most) * 1e-12
    bounds = tree.bounds(queries) + slack
    for q, found in enumerate(best):
        bound = bounds[q]
        todo = [(-bound[0], 0)]
        while todo and -todo[0][0] >= found.kth():  # equal bounds may hold a tie with a smaller id
            part, first = tree.parts[heapq.heappop(todo)[1]]
            if part is None:
                for child in (first, first + 1):
                    if bound[child] >= found.kth():
                        heapq.heappush(todo, (-bound[child], child))
            else:
                found.add(products(tree.vectors[part], queries[q], exact), ids[part], rows[part], own[q])


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """(row, vec_id, size, v): floor(scale * x) of vectors without null or non-finite components."""
    double = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("embedding").isNotNull() & F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform(double, lambda x: F.floor(x * scale)).alias("v"))
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("size"), "v")


@dataclass(frozen=True)
class Splits:
    """The upper splits of a KD-tree: axis and value of each node, its children, and at its leaves their number (else -1)."""

    axis: np.ndarray
    value: np.ndarray
    child: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def of(sample: np.ndarray, cells: int) -> Splits:
        """Median splits of the widest side until there are so many leaves; fewer where the sample's vectors are alike."""
        nodes, open_, leaves = [], [(np.arange(len(sample)), cells)], 0
        while len(nodes) < len(open_):
            ids, want = open_[len(nodes)]
            own = sample[ids]
            width = own.max(0).astype(np.float64) - own.min(0) if len(ids) else np.zeros(1)
            axis = int(width.argmax())
            if want < 2 or len(ids) < 2 or width[axis] == 0:
                nodes.append((0, 0, 0, leaves))
                leaves += 1
                continue
            value = np.sort(own[:, axis])[len(ids) // 2]
            value = value if (own[:, axis] < value).any() else own[own[:, axis] > value, axis].min()
            nodes.append((axis, value, len(open_), -1))
            low = own[:, axis] < value
            open_ += [(ids[low], want - want // 2), (ids[~low], want // 2)]
        return Splits(*(np.array(x, np.int64) for x in zip(*nodes)))

    def deal(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        node = np.zeros(len(vectors), np.int64)
        while len(inner := np.flatnonzero(self.leaf[node] < 0)):
            at = node[inner]
            node[inner] = self.child[at] + (vectors[inner, self.axis[at]] >= self.value[at])
        return self.leaf[node]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Arrays of the same length as rows."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), np.int64)


def laid_out(kept: DataFrame, cell: int) -> tuple[dict[int, Splits], DataFrame]:
    """Splits for each width of which there are more vectors than a cell holds, and (size, n, most): counts by width."""
    most = F.least(F.lit(cell).cast("long"), F.greatest(F.floor(F.lit(BYTES) / (8 * F.greatest("size", F.lit(1)))), F.lit(1)))
    counts = stored(kept.groupBy("size").agg(F.count("*").alias("n")).withColumn("most", most), "counts")
    out = {}
    for r in counts.where((F.col("n") > F.col("most")) & (F.col("size") > 0)).collect():
        sample = max(1, min(SAMPLE, BYTES // (8 * r["size"])))
        part = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < min(1 << 30, (sample << 30) // r.n)
        some = kept.where((F.col("size") == r["size"]) & part).select("v").toArrow()
        out[r["size"]] = Splits.of(matrix(some.column("v")), -(-r.n // r.most))
    return out, counts


PLACE = ["size", "leaf", "part"]
FOUND = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])
FOUND_SQL = "query_id long, query_row long, vec_id long, row long, score long"
LAST = np.iinfo(np.int64).max


def results(ids: np.ndarray, rows: np.ndarray, best: list[Best]) -> pa.Table:
    found = [(int(i), int(r), None if -c == LAST else -c, -x, s) for i, r, b in zip(ids, rows, best) for s, c, x in b.heap]
    return pa.Table.from_batches([batch(FOUND, **(dict(zip(FOUND.names, zip(*found))) if found else {n: [] for n in FOUND.names}))])


def packed_cell(rows: pa.Table) -> pa.Table:
    """A cell's vectors as one row, with the box around them."""
    v = matrix(rows.column("v"))
    ids = rows.column("vec_id").combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)
    place = {c: [rows.column(c)[0].as_py()] for c in PLACE}
    return pa.table({**place, "low": pa.array([v.min(0)], pa.list_(pa.int64())), "high": pa.array([v.max(0)], pa.list_(pa.int64())), "ids": [ids.astype(np.int64).tobytes()], "rows": [rows.column("row").to_numpy().astype(np.int64).tobytes()], "data": [v.tobytes()]})


def search_cell(cell: pa.Table, asked: pa.Table, k: int, shard: int) -> pa.Table:
    """The best of a cell for each query, whose kth score elsewhere is the floor; a KD-tree per shard."""
    if not asked.num_rows or not cell.num_rows:
        return FOUND.empty_table()
    ids, rows = (np.frombuffer(cell.column(c)[0].as_py(), np.int64) for c in ("ids", "rows"))
    v = np.frombuffer(cell.column("data")[0].as_py(), np.int64).reshape(len(ids), -1) if len(cell.column("data")[0].as_py()) else np.zeros((len(ids), 0), np.int64)
    q_ids, q_rows, q = asked.column("q_id").to_numpy(), asked.column("q_row").to_numpy(), matrix(asked.column("q_v"))
    best = [Best(k, -np.inf if f is None else f) for f in asked.column("q_floor").to_pylist()]
    for at in range(0, len(ids), shard):
        some = slice(at, at + shard)
        search(best, q, q_rows, Tree(v[some]), ids[some], rows[some])
    return results(q_ids, q_rows, best)


def reached(boxes: pa.Table, asked: pa.Table) -> pa.Table:
    """(q_row, size, leaf, part) of the cells, other than a query's own, whose box can hold a vector as good as its kth."""
    shape = pa.schema([("q_row", pa.int64()), *((c, pa.int64()) for c in PLACE)])
    if not asked.num_rows or not boxes.num_rows:
        return shape.empty_table()
    low, high, q = matrix(boxes.column("low")).astype(np.float64), matrix(boxes.column("high")).astype(np.float64), matrix(asked.column("q_v")).astype(np.float64)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    floor = np.array([-np.inf if f is None else f for f in asked.column("q_floor").to_pylist()], np.float64)
    leaf, part = (boxes.column(c).to_numpy() for c in ("leaf", "part"))
    home = (asked.column("q_leaf").to_numpy()[:, None] == leaf) & (asked.column("q_part").to_numpy()[:, None] == part)
    # sums of doubles can be a little off where they pass 2^53
    a, b = np.nonzero((bound + np.abs(bound) * 1e-12 >= floor[:, None]) & ~home)
    return pa.table({"q_row": asked.column("q_row").to_numpy()[a], "size": np.full(len(a), q.shape[1]), "leaf": leaf[b], "part": part[b]}, schema=shape)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, shard: int = SHARD, cell: int = CELL, block: int = BLOCK, boxes: int = BOXES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k greatest inner products, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by every; candidates are all other rows, the rows of the same id
    among them. Vectors are dealt to cells of bounded size by the upper splits of a KD-tree, which a sample lays out. A
    query first searches its own cell, by a KD-tree per shard and best first, and carries its kth score on: it is sent
    only to those cells whose box can hold a vector as good. Each cell gives k rows per query at most.

    Null vectors, and those holding null or non-finite components, take no part. Vectors of another length than the
    query's are no candidates for it; empty vectors score 0 with each other. A null vec_id makes no query; as a
    candidate it comes after all others of its score. Repeated rows are rows of their own; of equal scores the smaller
    vec_id comes first, then the earlier row. Vectors of any width are met in as small cells as keep to BYTES. Scores
    are exact while the sums of products fit a long. Other columns are not looked at; an empty table gives an empty
    result.
    """
    with scratch() as keep:
        kept = stored(whole_numbers(vectors, scale), "vectors")
        splits, counts = laid_out(kept, cell)
        shared = vectors.sparkSession.sparkContext.broadcast(splits)

        def deal(batches):
            for b in batches:
                leaf, size = np.zeros(b.num_rows, np.int64), b.column(2).to_numpy()
                for width, own in shared.value.items():
                    if len(some := np.flatnonzero(size == width)):
                        leaf[some] = own.deal(matrix(pa.chunked_array([b.column(3).take(pa.array(some))])))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=[*b.schema.names, "leaf"])

        dealt = stored(kept.select("row", "vec_id", F.col("size").cast("long").alias("size"), "v").mapInArrow(deal, "row long, vec_id long, size long, v array<long>, leaf long"), "dealt")
        held = dealt.groupBy("size", "leaf").agg(F.count("*").alias("held")).join(counts.select(F.col("size").cast("long").alias("size"), "most"), "size")
        dealt = dealt.join(held.select("size", "leaf", F.ceil(F.col("held") / F.col("most")).alias("parts")), ["size", "leaf"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
        cells = stored(dealt.groupBy(*PLACE).applyInArrow(packed_cell, "size long, leaf long, part long, low array<long>, high array<long>, ids binary, rows binary, data binary"), "cells")
        query = [F.col("vec_id").alias("q_id"), F.col("row").alias("q_row"), F.col("v").alias("q_v"), F.col("leaf").alias("q_leaf"), F.col("part").alias("q_part"), F.col("size").alias("q_size")]
        asked = stored(dealt.where(F.coalesce(F.col("vec_id") % every == 0, F.lit(False))).select(*query), "asked")
        find = lambda own, q: search_cell(own, q, k, shard)
        at_home = asked.withColumn("q_floor", F.lit(None).cast("long"))
        first = stored(cells.groupBy(*PLACE).cogroup(at_home.groupBy("q_size", "q_leaf", "q_part")).applyInArrow(lambda own, q: find(own, q), FOUND_SQL), "first")
        floors = first.groupBy("query_row").agg(F.when(F.count("*") == k, F.min("score")).alias("q_floor"))
        sizes = asked.groupBy("q_size").agg(F.count("*").alias("q")).join(cells.groupBy("size").agg(F.count("*").alias("c")), F.col("q_size") == F.col("size")).join(counts.select(F.col("size").alias("s"), "most"), F.col("q_size") == F.col("s"))
        sizes = sizes.select("q_size", F.ceil(F.col("q") / F.least(F.lit(block).cast("long"), F.col("most"))).alias("blocks"), F.ceil(F.col("c") / F.least(F.lit(boxes).cast("long"), F.col("most"))).alias("lots"))
        asked = asked.join(floors.select(F.col("query_row").alias("q_row"), "q_floor"), "q_row", "left").join(sizes, "q_size").withColumn("block", F.pmod(F.xxhash64("q_row"), F.col("blocks")))
        asked = stored(asked, "asked")
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        meet = cells.select(*PLACE, "low", "high").join(sizes.withColumnRenamed("q_size", "size"), "size").withColumn("lot", F.pmod(F.xxhash64("leaf", "part"), F.col("lots"))).withColumn("block", each("blocks"))
        pairs = meet.groupBy("size", "block", "lot").cogroup(asked.withColumn("lot", each("lots")).groupBy("q_size", "block", "lot")).applyInArrow(reached, "q_row long, size long, leaf long, part long")
        visits = stored(pairs.join(asked.select("q_row", "block"), "q_row"), "visits")
        wanted = cells.join(visits.select(*PLACE, "block").distinct(), PLACE)
        sent = visits.join(asked.select("q_row", "q_id", "q_v", "q_floor"), "q_row").select(*[F.col(c).alias(f"to_{c}") for c in (*PLACE, "block")], "q_row", "q_id", "q_v", "q_floor")
        rest = wanted.groupBy(*PLACE, "block").cogroup(sent.groupBy(*[f"to_{c}" for c in (*PLACE, "block")])).applyInArrow(lambda own, q: find(own, q), FOUND_SQL)
        both = keep(stored(first.unionByName(rest), "found"))
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(vectors: DataFrame) -> DataFrame:
    return top_k(vectors)


OP5_SQL = """
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.r AS query_row, c.vec_id, c.r,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), k AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, r) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
