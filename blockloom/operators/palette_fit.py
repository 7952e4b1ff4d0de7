"""Single pixels through palettes: one index and one case of lowest bits for all four channels, ends for each of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from blockloom.functions.channels import WEIGHTS
from blockloom.operators.cluster import shape

#: Pixels that meet a table at once: a few MB for the widest.
STEP = 8192


def table(bits: int, index_bits: int, cases: list[tuple[int, int] | None]) -> tuple[np.ndarray, np.ndarray]:
    """(far, ends) for each of 256 values and each candidate, which is a case and an index of the lower half: the distance
    of the nearest level, and the first pair of ends, as first * 256 + last, that makes it."""
    wide = bits + (cases[0] is not None)
    first, last = np.divmod(np.arange(1 << 2 * bits), 1 << bits)
    far, ends = [], []
    for case in cases:
        s, e = ((x if case is None else 2 * x + low) for x, low in zip((first, last), case or (0, 0)))
        s, e = ((x << 8 - wide) | (x >> 2 * wide - 8) if wide < 8 else x for x in (s, e))
        for w in WEIGHTS[index_bits][: 1 << index_bits - 1]:
            made, at = np.unique((s * (64 - w) + e * w) >> 6, return_index=True)
            apart = np.abs(np.arange(256)[:, None] - made)
            # of levels equally near, the one whose ends come first
            best = (apart * len(first) + at).argmin(1)
            far.append(apart[np.arange(256), best])
            ends.append(first[at[best]] * 256 + last[at[best]])
    return np.stack(far, 1), np.stack(ends, 1)


def fit_pixels(pixels: DataFrame, keys: list[str], palettes: dict[str, tuple[int, int, list]]) -> DataFrame:
    """(keys, palette, case, idx, error, and first and last end of r, g, b and a): each pixel's best fit by each palette.

    Pixels are rows (keys, r, g, b, a) of 0 to 255. The sum of squared errors counts; of equal ones the first case, then the
    first index. A pixel with a null channel has no fit, and gives no row. Nothing is shuffled, and no row is looked at twice:
    tables are some hundred numbers for each value, by their rule.
    """
    tables = {name: (far.astype(np.int32) ** 2, ends.astype(np.int32)) for name, (far, ends) in ((n, table(*p)) for n, p in palettes.items())}
    halves = {name: 1 << p[1] - 1 for name, p in palettes.items()}
    sides = [f"{c}_{e}" for c in "rgba" for e in ("first", "last")]

    def work(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                b = whole.slice(at, STEP)
                v = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in "rgba"], 1).astype(np.int64)
                for name, (far, ends) in tables.items():
                    error = far[v].sum(1)
                    best = error.argmin(1)
                    pairs = ends[v, best[:, None]]
                    found = {"palette": pa.array([name] * len(v)), "case": best // halves[name], "idx": best % halves[name], "error": error[np.arange(len(v)), best]}
                    found |= {s: pairs[:, k // 2] % 256 if k % 2 else pairs[:, k // 2] // 256 for k, s in enumerate(sides)}
                    yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(x if isinstance(x, pa.Array) else pa.array(x.astype(np.int64)) for x in found.values())], names=[*keys, *found])

    own = pixels.select(*keys, *"rgba").dropna(subset=list("rgba"))
    longs = ", ".join(f"{c} long" for c in ("`case`", "idx", "error", *sides))
    return own.mapInArrow(work, f"{shape(own, keys)}, palette string, {longs}")
