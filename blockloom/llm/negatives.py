"""Hard negatives by norm-bucketed search: candidates sorted by norm, buckets pruned by the Cauchy-Schwarz bound."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, scratch, stored
from .topk import EXACT, LAST, matrix, whole_numbers

#: Vectors of a bucket, buckets of a lot that one task walks through, anchors of a block; bytes of vectors of a bucket or block at most.
BUCKET, LOT, BLOCK, BYTES = 4096, 4, 8192, 32 << 20
#: Scores of a slice of a block that are held at once.
SCORES = 1 << 21
#: Bounds are sums of doubles: they may be off by this share.
SLACK = 1 + 1e-9
LOWEST = np.iinfo(np.int64).min

FOUND_SQL = "q_row long, high long, id long, row long, score long"
FOUND = pa.schema([(c.split()[0], pa.int64()) for c in FOUND_SQL.split(", ")])
BUCKET_SQL = "size long, task long, lot long, most double, item long, ids binary, rows binary, labels binary, data binary"
BLOCK_SQL = "size long, block long, need double, item long, rows binary, labels binary, norms binary, counts binary, highs binary, floors binary, data binary"
SCHEMAS = {s: pa.schema([(c.split()[0], {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[c.split()[1]]) for c in s.split(", ")]) for s in (BUCKET_SQL, BLOCK_SQL)}


def runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Sorted record batches as tables of vectors of one width each, of so many rows and BYTES at most."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        while b.num_rows:
            size = b.column("size").to_numpy()
            if held and held[0].column("size")[0].as_py() != size[0]:
                yield pa.Table.from_batches(held)
                held = []
            most = max(1, min(rows, BYTES // (8 * max(1, int(size[0])))))
            n = min(int((size == size[0]).sum()), most - sum(x.num_rows for x in held))
            held.append(b.slice(0, n))
            b = b.slice(n)
            if sum(x.num_rows for x in held) == most:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def packed(v: np.ndarray) -> dict:
    """Whole numbers in as few bytes each as hold all of them."""
    for kind in (np.int8, np.int16, np.int32, np.int64):
        if not v.size or (np.iinfo(kind).min <= v.min() and v.max() <= np.iinfo(kind).max):
            return {"item": [np.dtype(kind).itemsize], "data": [v.astype(kind).tobytes()]}


def unpacked(row: dict, n: int) -> np.ndarray:
    flat = np.frombuffer(row["data"], np.dtype(f"i{row['item']}")).astype(np.int64)
    return flat.reshape(n, -1) if len(flat) else np.zeros((n, 0), np.int64)


def longs(column: pa.ChunkedArray, missing: int = LAST) -> list[bytes]:
    return [column.combine_chunks().fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()]


def in_buckets(kept: DataFrame, bucket: int, lot: int) -> DataFrame:
    """Candidates sorted by falling norm, as buckets of one row each, and these in lots; none passes from task to task."""

    def pack(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for k, t in enumerate(runs(batches, bucket)):
            yield batch(SCHEMAS[BUCKET_SQL], size=[t.column("size")[0].as_py()], task=[task], lot=[k // lot], most=[t.column("norm")[0].as_py()], ids=longs(t.column("vec_id")), rows=longs(t.column("row")), labels=longs(t.column("label")), **packed(matrix(t.column("v"))))

    order = [F.col("size"), F.col("norm").desc(), F.col("row")]
    return kept.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, BUCKET_SQL)


def in_blocks(asked: DataFrame, block: int) -> DataFrame:
    """Anchors sorted by the norm that a candidate needs to matter, as blocks of one row each."""

    def pack(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for k, t in enumerate(runs(batches, block)):
            high, floor = (t.column(c).combine_chunks() for c in ("high", "floor"))
            yield batch(
                SCHEMAS[BLOCK_SQL], size=[t.column("size")[0].as_py()], block=[(task << 32) + k], need=[t.column("need").combine_chunks().to_numpy(zero_copy_only=False).min()], rows=longs(t.column("row")), labels=longs(t.column("label")),
                norms=[t.column("norm").combine_chunks().to_numpy().tobytes()], counts=[np.diff(high.offsets.to_numpy()).astype(np.int64).tobytes()], highs=[high.flatten().to_numpy().tobytes()], floors=[floor.flatten().to_numpy().tobytes()], **packed(matrix(t.column("v"))),
            )

    least = F.array_min("floor").cast("double")
    need = F.when(F.col("norm") > 0, least / F.col("norm")).otherwise(F.when(least > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
    order = [F.col("size"), F.col("need").desc(), F.col("row")]
    return asked.withColumn("need", need).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, BLOCK_SQL)


class Windows:
    """A block's anchors with their windows of scores, and the first k candidates found in each: score, id, row."""

    def __init__(self, block: dict, k: int) -> None:
        get = lambda c, kind=np.int64: np.frombuffer(block[c], kind)
        self.k, self.rows, self.labels, self.norms, self.high, self.floor = k, get("rows"), get("labels"), get("norms", np.float64), get("highs"), get("floors").copy()
        self.v, self.last = unpacked(block, len(self.rows)), np.cumsum(get("counts"))
        self.first = self.last - get("counts")
        self.found: list[np.ndarray] = [np.zeros((3, 0), np.int64)] * len(self.high)
        self.least = np.minimum.reduceat(self.floor, self.first) if len(self.rows) else self.floor

    def open(self, most: float) -> np.ndarray:
        """The anchors that a candidate of at most this norm can still matter to."""
        return np.flatnonzero(self.norms * most * SLACK >= self.least)

    def add(self, a: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        for w in range(self.first[a], self.last[a]):
            some = np.flatnonzero((scores >= self.floor[w]) & (scores <= self.high[w]))
            if not len(some):
                continue
            if len(some) > 8 * self.k:  # all that tie with the kth stay
                s = scores[some]
                some = some[s >= np.partition(s, -self.k)[-self.k]]
            own = np.concatenate([self.found[w], [scores[some], ids[some], rows[some]]], axis=1)
            self.found[w] = own[:, np.lexsort((own[2], own[1], -own[0]))[: self.k]]
            if self.found[w].shape[1] == self.k:
                self.floor[w] = max(self.floor[w], self.found[w][0, -1])
        self.least[a] = self.floor[self.first[a] : self.last[a]].min()

    def search(self, bucket: dict, same: bool) -> None:
        """Scores a bucket's candidates of the same label, or of others, for all anchors that they can matter to."""
        ids, rows, labels = (np.frombuffer(bucket[c], np.int64) for c in ("ids", "rows", "labels"))
        if not len(open_ := self.open(bucket["most"])):
            return
        c = unpacked(bucket, len(ids))
        exact = not c.size or int(np.abs(self.v).max()) * int(np.abs(c).max()) * c.shape[1] <= EXACT
        v, c = (x.astype(np.float64) if exact else x for x in (self.v, c))
        groups = [(open_[self.labels[open_] == x], np.flatnonzero(labels == x)) for x in np.intersect1d(labels, self.labels[open_])] if same else [(open_, np.arange(len(ids)))]
        for anchors, some in groups:
            step = max(1, SCORES // max(1, len(some)))
            for at in range(0, len(anchors), step):
                part = anchors[at : at + step]
                all_ = (v[part] @ c[some].T).astype(np.int64)
                for a, scores in zip(part, all_):
                    fair = np.flatnonzero((scores >= self.least[a]) & ((rows[some] != self.rows[a]) if same else (labels != self.labels[a])))
                    self.add(a, scores[fair], ids[some[fair]], rows[some[fair]])

    def results(self) -> pa.Table:
        n = [x.shape[1] for x in self.found]
        owner = np.repeat(self.rows, self.last - self.first)
        score, ids, rows = np.concatenate([np.zeros((3, 0), np.int64), *self.found], axis=1)
        return pa.Table.from_batches([batch(FOUND, q_row=np.repeat(owner, n), high=np.repeat(self.high, n), id=ids, row=rows, score=score)])


def walk(k: int, same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A lot's buckets in falling order of norm for one block of anchors; the kth score so far comes along."""

    def run(buckets: pa.Table, block: pa.Table) -> pa.Table:
        if not buckets.num_rows or not block.num_rows:
            return FOUND.empty_table()
        own = Windows({c: block.column(f"q_{c}")[0].as_py() for c in SCHEMAS[BLOCK_SQL].names}, k)
        for at in np.argsort(-buckets.column("most").to_numpy(), kind="stable"):
            own.search({c: buckets.column(c)[int(at)].as_py() for c in buckets.column_names}, same)
        return own.results()

    return run


def first_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_row", "high").orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(asked: DataFrame, buckets: DataFrame, k: int, same: bool, block: int) -> DataFrame:
    """(q_row, high, id, row, score, rank): the first k candidates, of the same label or of others, in each anchor's windows.

    Anchors (row, label, size, v, norm, high, floor) first meet the lot of greatest norms, which raises their windows'
    floors to the kth scores there; then all lots with a candidate long enough to reach the least floor of a block. The
    table of norms by task has as many rows as there are tasks and widths.
    """
    levels = buckets.groupBy("size", "task").agg(F.max("most").alias("most"), F.max("lot").alias("lots"))
    top = levels.groupBy("size").agg(F.min("task").alias("top"))
    levels = stored(levels.join(top, "size"), "levels")
    run = walk(k, same)

    def visit(blocks: DataFrame, first: bool) -> DataFrame:
        pairs = blocks.select("size", "block", "need").join(F.broadcast(levels), "size").where(F.col("most") * SLACK >= F.col("need"))
        pairs = pairs.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), "lots")))
        at_top = (F.col("task") == F.col("top")) & (F.col("lot") == 0)
        pairs = pairs.where(at_top if first else ~at_top).select("size", "task", "lot", "block")
        sent = blocks.select(*[F.col(c).alias(f"q_{c}") for c in blocks.columns]).join(pairs.withColumnRenamed("block", "q_block").drop("size"), "q_block")
        reached = buckets.join(pairs, ["size", "task", "lot"])
        return reached.groupBy("size", "task", "lot", "block").cogroup(sent.groupBy("q_size", "task", "lot", "q_block")).applyInArrow(run, FOUND_SQL)

    begun = stored(visit(stored(in_blocks(asked, block), "blocks"), True), "begun")
    floors = first_k(begun, k).groupBy("q_row", "high").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
    floors = floors.groupBy("q_row").agg(F.map_from_entries(F.collect_list(F.struct("high", "kth"))).alias("kth"))
    raised = F.transform(F.arrays_zip("high", "floor"), lambda w: F.greatest(w["floor"], F.try_element_at("kth", w["high"])))
    again = asked.join(floors.select(F.col("q_row").alias("row"), "kth"), "row", "left").withColumn("floor", F.when(F.col("kth").isNull(), F.col("floor")).otherwise(raised)).drop("kth")
    rest = stored(visit(stored(in_blocks(again, block), "blocks"), False), "rest")
    return first_k(begun.unionByName(rest), k)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, bucket: int = BUCKET, lot: int = LOT, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by every; scores are whole inner products of floor(scale * x). An
    anchor's positives are its best other rows of its label; its negatives for a positive are the best rows of other
    labels from low hundredths of the positive's score up to it, both ends included (none for a score below 0). Equal
    scores go by the smaller vec_id, then the earlier row.

    All candidates are sorted by norm and cut in buckets, whatever labels they have and however often a vector is
    repeated. A bucket is looked at only for anchors whose norm times the bucket's greatest can reach a window's lower
    limit or kth score; blocks of anchors are not even sent where none can. Where all norms are alike, every block meets
    every bucket: the bound cannot tell them apart.

    Rows with a null label, a null vector, or a null or non-finite component take no part. A null vec_id makes no
    anchor; as positive or negative it comes after all others of its score. Repeated rows are rows of their own. Vectors
    of another length than the anchor's are no candidates for it; empty ones score 0 with each other. Labels are whole
    numbers. Scores are exact while sums of products fit a long. Other columns are not looked at; an empty table gives
    an empty result.
    """
    kept_columns = F.struct("vec_id", F.col("label").cast("long").alias("label"))
    with scratch() as keep:
        # the checks and whole numbers are those of the exact search; vec_id and label pass through as one column
        kept = whole_numbers(vectors.where(F.col("label").isNotNull()).select(kept_columns.alias("vec_id"), "embedding"), scale)
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        kept = stored(kept.select("row", F.col("vec_id.vec_id").alias("vec_id"), F.col("vec_id.label").alias("label"), F.col("size").cast("long").alias("size"), "v", norm.alias("norm")), "vectors")
        buckets = stored(in_buckets(kept, bucket, lot), "buckets")
        anchors = kept.where(F.coalesce(F.col("vec_id") % every == 0, F.lit(False)))
        all_ = anchors.withColumns({"high": F.array(F.lit(LAST)), "floor": F.array(F.lit(LOWEST))})
        near = stored(searched(all_, buckets, positives, True, block), "positives")
        # the least whole number of at least so many hundredths of a score, without passing the range of a long
        limit = F.expr(f"transform(high, s -> s - (s div 100) * {100 - low} - ((s % 100) * {100 - low}) div 100)")
        windows = near.where(F.col("score") >= 0).groupBy("q_row").agg(F.collect_set("score").alias("high")).withColumn("floor", limit)
        asked = anchors.join(windows.withColumnRenamed("q_row", "row"), "row")
        far = searched(asked, buckets, negatives, False, block)
        pairs = near.select("q_row", F.col("id").alias("positive_id"), F.col("score").alias("high"))
        names = anchors.select(F.col("row").alias("q_row"), F.col("vec_id").alias("anchor_id"))
        both = far.join(pairs, ["q_row", "high"]).join(names, "q_row")
        real = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
        both = both.select("anchor_id", real("positive_id"), "rank", F.when(F.col("id") != LAST, F.col("id")).alias("negative_id"), F.col("high").alias("positive_score"), F.col("score").alias("negative_score"))
        return keep(stored(both, "negatives"))


def op11_negatives(vectors: DataFrame) -> DataFrame:
    """Every seventh vec_id first gets the next label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", moved.alias("label")))


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.r <> c.r AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) AS place FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY s.score DESC, s.vec_id, s.r) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.place <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
