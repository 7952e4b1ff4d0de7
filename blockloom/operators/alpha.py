"""Alpha of BC3 by both of its codebooks, searched together: our own search, on the levels that a decoder makes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from blockloom.operators.cluster import in_steps, shape

#: Ends move inwards by up to so many, less one, each by itself.
MOVES = 4


def levels(low: np.ndarray, high: np.ndarray, wide: bool) -> np.ndarray:
    """(…, 8): six levels between falling ends, or four between rising ones and then 0 and 255."""
    if wide:
        return np.stack([high, low, *(((7 - k) * high + k * low) // 7 for k in range(1, 7))], -1)
    return np.stack([low, high, *(((5 - k) * low + k * high) // 5 for k in range(1, 5)), np.zeros_like(low), np.full_like(low, 255)], -1)


def best_alpha(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eight bytes, squared error) of alphas (blocks, 16): the wide book first among equals, then the ends that moved least.

    The ends of the wide book are the least and the greatest alpha, those of the other the least and the greatest but for
    0 and 255, which it has anyway; both move inwards in all ways while they keep their order.
    """
    inner = (v > 0) & (v < 255)
    some = inner.any(1)
    books = [(True, v.min(1), v.max(1)), (False, np.where(some, np.where(inner, v, 255).min(1), 0), np.where(some, np.where(inner, v, 0).max(1), 0))]
    best, out = np.full(len(v), np.iinfo(np.int64).max), np.zeros((len(v), 8), np.int64)
    for wide, low, high in books:
        for i in range(MOVES):
            for j in range(MOVES):
                a, b = low + i, high - j
                fair = (a < b) if wide else (a <= b)
                far = (v[:, :, None] - levels(a, b, wide)[:, None, :]) ** 2
                codes = far.argmin(2)
                error = np.where(fair, np.take_along_axis(far, codes[:, :, None], 2)[:, :, 0].sum(1), np.iinfo(np.int64).max)
                words = codes.reshape(-1, 2, 8) @ (1 << np.arange(0, 24, 3))
                own = np.concatenate([np.stack([b, a] if wide else [a, b], 1), ((words[:, :, None] >> np.array([0, 8, 16])) & 255).reshape(-1, 6)], 1)
                out, best = np.where((error < best)[:, None], own, out), np.minimum(best, error)
    return out, best


def both_books(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, alpha, error): eight bytes of alpha for blocks (keys, e) of 64 RGBA values or bytes, and their squared error."""

    def work(e: np.ndarray) -> dict[str, pa.Array]:
        out, error = best_alpha(e[:, :, 3])
        return {"alpha": pa.array(list(out), pa.list_(pa.int64())), "error": pa.array(error)}

    own = blocks.select(*keys, "e")
    return own.mapInArrow(lambda batches: in_steps(batches, keys, work), f"{shape(own, keys)}, alpha array<long>, error long")
