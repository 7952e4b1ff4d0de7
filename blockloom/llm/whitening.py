"""Whitening of embeddings by the eigenvectors of their exactly centred covariance."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored
from .topk import whole_numbers

#: Components that are returned at most.
COMPONENTS = 4
#: Wider vectors are refused: their covariance, width squared doubles, is worked out on the driver.
WIDEST = 4096
#: A component whose eigenvalue is this share of the greatest, or less, has no variance beyond rounding.
NOISE = 1e-12
LONG = (1 << 63) - 1

OUT = "vec_id {0}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def fit(distinct: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and each dimension's sum, as whole numbers."""
    sums = distinct.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("s")).collect()
    found = {r["at"]: r["s"] for r in sums}
    return distinct.count(), [found.get(k, 0) for k in range(width)]


def components(distinct: DataFrame, n: int, sums: list[int], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues and unit eigenvectors of the covariance (divisor n) by falling eigenvalue, and its trace.

    Rows are centred as the whole numbers n*x - S before they become doubles, so nothing cancels; the products are
    summed up by the row matrix, and only its square of width by width comes to the driver.
    """
    centred = F.transform("v", lambda x, k: (x * n - F.element_at(F.lit(sums).cast("array<bigint>"), (k + 1).cast("int"))).cast("double") / n)
    rows = MLUtils.convertVectorColumnsFromML(distinct.select(array_to_vector(centred).alias("row")), "row")
    covariance = RowMatrix(rows, n, len(sums)).computeGramianMatrix().toArray() / n
    value, vector = np.linalg.eigh(covariance)
    order = np.argsort(-value, kind="stable")[:most]
    return np.maximum(value[order], 0), vector[:, order], float(np.trace(covariance))


def squares(y: np.ndarray) -> list[int]:
    """Each row's sum of squares, exact whatever its size."""
    wide = y.size and int(np.abs(y).max()) ** 2 * y.shape[1] > LONG
    return [int(x) for x in ((y.astype(object) ** 2).sum(1) if wide else (y * y).sum(1))]


def whitened(rows: DataFrame, n: int, sums: list[int], value: np.ndarray, vector: np.ndarray, real: int) -> DataFrame:
    """(vec_id, deviation, deviation_exact, whitened) for rows (vec_id, v); components past the first real ones are 0."""
    scale = np.where(np.arange(len(value)) < real, np.sqrt(np.maximum(value, np.finfo(float).tiny)), np.inf)
    shared = rows.sparkSession.sparkContext.broadcast((np.array(sums, np.int64), vector / scale))

    def run(frames):
        total, axes = shared.value
        for f in frames:
            y = np.array(f["v"].tolist(), np.int64).reshape(len(f), len(total)) * n - total
            exact = squares(y)
            yield pd.DataFrame({"vec_id": f["vec_id"], "deviation": pd.array([x if x <= LONG else None for x in exact], "Int64"), "deviation_exact": [Decimal(x) for x in exact], "whitened": list((y.astype(np.float64) / n) @ axes)})

    return rows.select("vec_id", "v").mapInPandas(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, deviation_exact decimal(38,0), whitened array<double>")


def identity_error(found: DataFrame, real: int) -> float:
    """The largest absolute entry of the covariance of whitened rows (each an array) minus the identity, over the first real components."""
    if not real:
        return 0.0
    each = found.select(*[F.element_at("whitened", k + 1).alias(f"w{k}") for k in range(real)])
    mean = each.agg(*[F.avg(c).alias(c) for c in each.columns]).first()
    pairs = [(a, b) for b in range(real) for a in range(b + 1)]
    covariance = each.agg(*[F.avg((F.col(f"w{a}") - mean[a]) * (F.col(f"w{b}") - mean[b])) for a, b in pairs]).first()
    return max(abs(c - (a == b)) for c, (a, b) in zip(covariance, pairs))


def whiten(vectors: DataFrame, most: int = COMPONENTS, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact): a row for each row of
    (vec_id, embedding) that takes part, and each of its first components.

    Components become whole numbers x = floor(scale * c). The mean S/n and the covariance come from each distinct x
    vector once; whitened is x - S/n on the unit eigenvector, over the root of its eigenvalue; explained is the
    eigenvalue's share of the trace; deviation is the exact sum of (n*x - S)^2, null where it is beyond a long, and
    deviation_exact has all its digits. identity_error measures the whitened fit list.

    Null vectors, and those holding null or non-finite components, take no part. Null, repeated and tied vec_ids are
    rows like others; repeated vectors count once in the fit and are all returned. Vectors of each width are fitted by
    themselves, those of no width give no rows; there are as many components as the width, at most. A component without variance (one
    distinct vector; all vectors in a plane) has whitened and explained 0, and identity_error leaves it out. Wider
    vectors than WIDEST are an error, as their covariance is worked out on the driver. Other columns are not looked at;
    an empty table gives an empty result.
    """
    with scratch() as keep:
        kept = keep(stored(whole_numbers(vectors, scale).select("vec_id", "size", "v"), "vectors"))
        out = [parts_of(kept.where(F.col("size") == r["size"]), r["size"], most) for r in kept.where("size > 0").groupBy("size").count().orderBy("size").collect()]
    if not out:
        return vectors.sparkSession.createDataFrame([], OUT.format(vectors.schema["vec_id"].dataType.simpleString()))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def parts_of(rows: DataFrame, width: int, most: int) -> DataFrame:
    """The rows of one width, fitted and whitened."""
    if width > WIDEST:
        raise ValueError(f"vectors of {width} components: their covariance is too wide for the driver")
    distinct = stored(rows.select("v").distinct(), "distinct")
    n, sums = fit(distinct, width)
    value, vector, trace = components(distinct, n, sums, most)
    real = int((value > NOISE * value[0]).sum())
    error = identity_error(whitened(distinct.select(F.lit(0).alias("vec_id"), "v"), n, sums, value, vector, real), real)
    found = whitened(rows, n, sums, value, vector, real).withColumn("identity_error", F.lit(float(error)))
    each = F.posexplode("whitened").alias("k", "whitened")
    share = F.element_at(F.array(*[F.lit(float(e / trace) if trace > 0 else 0.0) for e in value]), F.col("k") + 1)
    return found.select("vec_id", each, "deviation", "deviation_exact", "identity_error").select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), "identity_error", "deviation_exact")


def op13_whitening(vectors: DataFrame) -> DataFrame:
    return whiten(vectors)
