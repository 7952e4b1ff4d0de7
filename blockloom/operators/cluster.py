"""Least-squares fits of our own: texels in order along an axis, cut in runs, ends by each split's normal equations.

All sums are whole numbers that doubles hold exactly, so that the same rules in SQL give the same bytes. Blocks are
rows; numpy works on a batch of them at a time, and nothing is shuffled.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from blockloom.operators import partitions
from blockloom.operators.encode import METRICS, WIDTHS

#: Blocks that are worked on together.
STEP = 64
#: Rounds of power iteration, and the greatest entry of an axis.
ROUNDS, UNIT = 8, 32767
#: Shares of the first end at each level: of a half, of thirds, and in 64ths for ends of 8 bits.
HALVES, THIRDS, QUARTER = (2, 1, 0), (3, 2, 1, 0), (64, 43, 21, 0)
COLOUR_BITS, FULL_BITS = tuple(w for _, w in WIDTHS), (8, 8, 8)
#: Bits that a block's ends are kept in, and those of the codes.
CODES = 1 << np.arange(0, 8, 2)


@lru_cache
def split_shares(levels: tuple[int, ...]) -> np.ndarray:
    """(16, splits): the first end's share at each place of the order, for all splits in runs, some of which may be empty."""
    cuts = combinations_with_replacement(range(17), len(levels) - 1)
    return np.array([np.repeat(levels, np.diff([0, *c, 16])) for c in cuts], np.float64).T


def expanded(g: np.ndarray, bits: int) -> np.ndarray:
    """Values of 5 to 8 bits as 8 bits, by repetition."""
    return g * (1 << 8 - bits) + np.floor(g / (1 << 2 * bits - 8)) if bits < 8 else g


def unit(v: np.ndarray) -> np.ndarray:
    most = np.abs(v).max(1, keepdims=True)
    return np.where(most > 0, np.floor(v.astype(np.float64) * UNIT / np.maximum(most, 1).astype(np.float64)), 0).astype(np.int64)


def principal_axis(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(blocks, 3): the main direction of weighted texels, by power iteration from the covariance's widest column."""
    s, q = np.einsum("bt,bti->bi", w, x), np.einsum("bt,bti,btj->bij", w, x, x)
    covariance = w.sum(1)[:, None, None] * q - s[:, :, None] * s[:, None, :]
    at = np.diagonal(covariance, axis1=1, axis2=2).argmax(1)
    v = unit(np.take_along_axis(covariance, at[:, None, None], 2)[:, :, 0])
    for _ in range(ROUNDS):
        v = unit(np.einsum("bij,bj->bi", covariance, v))
    return v


def rounded(n: np.ndarray, det: np.ndarray, top: int, whole: int) -> np.ndarray:
    """whole * n / det, of 0 to 255, to the nearest of the steps from 0 to top."""
    return np.clip(np.floor((2 * top * whole * n + 255 * det) / (510 * det)), 0, top)


class Splits:
    """The normal equations of all splits of blocks whose texels are in order: sums of shares, and of shares by channel."""

    def __init__(self, x: np.ndarray, w: np.ndarray, levels: tuple[int, ...], metric: tuple[int, ...]) -> None:
        self.whole, self.a, self.metric = levels[0], split_shares(levels), metric
        alike = (w == w[:1]).all()
        own = w[:1] if alike else w  # sums of shares are the same for all blocks where weights are
        once = own @ self.a
        self.aa = own @ (self.a * self.a)
        self.bb, self.ab = self.whole**2 * own.sum(1, keepdims=True) - 2 * self.whole * once + self.aa, self.whole * once - self.aa
        self.det = self.aa * self.bb - self.ab * self.ab
        self.wx = w[:, :, None] * x
        self.sums, self.squares = self.wx.sum(1), (self.wx * x).sum(1)
        self.ax = [self.wx[:, :, k] @ self.a for k in range(3)]

    def bounds(self) -> np.ndarray:
        """What no ends can be below: the error of the exact solution, which needs no rounding; infinite where there is none."""
        total, bad = self.whole * self.sums, self.det <= 0
        det = np.where(bad, 1, self.det) / self.whole**2
        cross = np.einsum("btk,bk->bt", self.wx, total * self.metric) @ self.a
        cross *= 2 * (self.ab + self.aa) / det
        square = self.ax[0] * self.ax[0]
        square *= self.metric[0]
        for m, ax in zip(self.metric[1:], self.ax[1:]):
            own = ax * ax
            square += own if m == 1 else m * own
        square *= (self.bb + 2 * self.ab + self.aa) / det
        cross -= square
        cross -= (self.aa / det) * ((total * total) @ self.metric)[:, None]
        cross += self.whole**2 * (self.squares @ self.metric)[:, None]
        if len(bad) == 1:
            cross[:, bad[0]] = np.inf
        else:
            cross[bad] = np.inf
        return cross

    def solved(self, block: np.ndarray, split: np.ndarray, bits: tuple[int, ...]) -> tuple[np.ndarray, list]:
        """Errors and ends, by channel, of some splits of some blocks."""
        row = block if len(self.det) > 1 else np.zeros_like(block)
        aa, bb, ab, det = (z[row, split] for z in (self.aa, self.bb, self.ab, self.det))
        error, ends, whole = np.zeros(len(block)), [], self.whole
        for k, width in enumerate(bits):
            ax = self.ax[k][block, split]
            bx = whole * self.sums[block, k] - ax
            own = [rounded(n, det, (1 << width) - 1, whole) for n in (ax * bb - bx * ab, bx * aa - ax * ab)]
            p, q = (expanded(g, width) for g in own)
            error += self.metric[k] * (p * (aa * p + 2 * (ab * q - whole * ax)) + q * (bb * q - 2 * whole * bx) + whole * whole * self.squares[block, k])
            ends.append(own)
        return error, ends


def best_split(x: np.ndarray, w: np.ndarray, axis: np.ndarray, levels: tuple[int, ...], bits: tuple[int, ...], metric: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(error, ends): the split of texels in order of their projection (then place) that leaves the least squared error.

    The error is in squares of the levels' whole share, infinite where no split has an answer; ends are (blocks, 2, 3)
    in as many bits as the channels have. The first split counts among equals. Rounding ends to their bits cannot lower
    an error, so only those splits are rounded whose exact solution is no worse than the best rounded so far.
    """
    n = len(x)
    order = np.argsort(np.einsum("bti,bi->bt", x, axis), axis=1, kind="stable")
    x, w = np.take_along_axis(x, order[:, :, None], 1).astype(np.float64), np.take_along_axis(w, order, 1).astype(np.float64)
    error, ends = np.full(n, np.inf), np.zeros((n, 2, 3), np.int64)
    if not n:
        return error, ends
    splits = Splits(x, w, levels, metric)
    bound = splits.bounds()
    first = bound.argmin(1)
    some = np.flatnonzero(np.isfinite(bound[np.arange(n), first]))
    error[some] = splits.solved(some, first[some], bits)[0]
    block, split = np.nonzero(bound <= np.where(np.isfinite(error), error, -1)[:, None] * (1 + 1e-9) + 1e-3)
    found, solved = splits.solved(block, split, bits)
    order = np.lexsort((split, found, block))
    at = order[np.unique(block[order], return_index=True)[1]]
    error[block[at]] = found[at]
    ends[block[at]] = np.stack([np.stack([own[e][at] for own in solved], 1) for e in (0, 1)], 1).astype(np.int64)
    return error, ends


def fitted(x: np.ndarray, w: np.ndarray, levels: tuple[int, ...], bits: tuple[int, ...], metric: tuple[int, ...], iterate: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """The best split along the principal axis; if iterating, before it what is found along the line between its ends, again and again.

    A block goes on only while its error falls. Errors are whole numbers of 0 and more, so every block comes to an end.
    """
    first = best_split(x, w, principal_axis(x, w), levels, bits, metric)
    if not iterate:
        return [first]
    error, ends = first[0].copy(), first[1].copy()
    active = np.flatnonzero(np.isfinite(error))
    while len(active):
        wide = np.stack([expanded(ends[active, :, k], n) for k, n in enumerate(bits)], 2).astype(np.int64)
        again, other = best_split(x[active], w[active], wide[:, 0] - wide[:, 1], levels, bits, metric)
        better = again < error[active]
        active = active[better]
        error[active], ends[active] = again[better], other[better]
    return [(error, ends), first]


def word(ends: np.ndarray) -> np.ndarray:
    return (ends[:, 0] << 11) + (ends[:, 1] << 5) + ends[:, 2]


def coded(x: np.ndarray, w: np.ndarray, first: np.ndarray, second: np.ndarray, four: bool, metric: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(error, codes) of texels on the colours that a decoder makes of two words; the lowest code among equals."""
    ends = [[expanded(word_ >> shift & ((1 << n) - 1), n).astype(np.int64) for shift, n in ((11, 5), (5, 6), (0, 5))] for word_ in (first, second)]
    between = ((2, 1, 3), (1, 2, 3)) if four else ((1, 1, 2),)
    levels = [*ends, *[[(s * p + t * q) // n for p, q in zip(*ends)] for s, t, n in between]]
    far = sum(m * (x[:, :, None, k] - np.stack([p[k] for p in levels], 1)[:, None, :]) ** 2 for k, m in enumerate(metric))
    codes = far.argmin(2)
    return (np.take_along_axis(far, codes[:, :, None], 2)[:, :, 0] * w).sum(1), codes


def weights_of(e: np.ndarray, weighted: bool) -> np.ndarray:
    """Each texel's weight: 1, or its alpha. Texels of alpha 0 count for nothing, unless no texel has another alpha: then all count alike."""
    if not weighted:
        return np.ones(e.shape[:2], np.int64)
    return np.where((e[:, :, 3] == 0).all(1)[:, None], 1, e[:, :, 3])


def block_bytes(e: np.ndarray, metric: tuple[int, ...], three: bool, weighted: bool, iterate: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eight bytes of BC1, error, the box's error) of blocks (n, 16, 4): the best, once decoded, of the four-colour fits, the three-colour fits and the box."""
    x, w = e[:, :, :3], weights_of(e, weighted)
    shift = np.array([8 - n for n in COLOUR_BITS])
    kinds = [(True, *k) for k in fitted(x, w, THIRDS, COLOUR_BITS, metric, iterate)]
    kinds += [(False, *k) for k in fitted(x, w, HALVES, COLOUR_BITS, metric, iterate)] if three else []
    kinds += [(True, np.zeros(len(e)), np.stack([x.max(1) >> shift, x.min(1) >> shift], 1))]
    best, out = np.full(len(e), np.inf), np.zeros((len(e), 8), np.int64)
    for four, found, ends in kinds:
        words = np.sort(np.stack([word(ends[:, 0]), word(ends[:, 1])], 1), 1)[:, ::-1 if four else 1]
        error, codes = coded(x, w, words[:, 0], words[:, 1], four, metric)
        error = np.where(np.isfinite(found), error, np.inf)
        own = np.concatenate([np.stack([words & 255, words >> 8], 2).reshape(-1, 4), codes.reshape(-1, 4, 4) @ CODES], 1)
        out, best = np.where((error < best)[:, None], own, out), np.minimum(best, error)
    return out, best.astype(np.int64), error.astype(np.int64)


def pixels(column: pa.Array) -> np.ndarray:
    """(blocks, 16, 4) of arrays of 64 numbers, or of 64 bytes each."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8) if pa.types.is_binary(column.type) else column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(-1, 16, 4)


def in_steps(batches, columns: list[str], work):
    """Hands blocks e of 64 numbers on in steps; columns come along, before what the work gives for them."""
    for b in batches:
        for at in range(0, b.num_rows, STEP):
            some = b.slice(at, STEP)
            e = pixels(some.column("e"))
            new = work(e)
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in columns), *new.values()], names=[*columns, *new])


def shape(blocks: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in columns)


def cluster_fit(blocks: DataFrame, keys: list[str], metric: str = "uniform", three: bool = True, weighted: bool = False, iterate: bool = False) -> DataFrame:
    """(keys, c, error, box_error): eight bytes of BC1 for blocks (keys, e) of 64 RGBA values or bytes, their squared error by the
    metric, and that of the range fit.

    The colours are split in runs along the principal axis in all ways, three or four colours to a block, and ends are
    those of least squares, cut to 5, 6 and 5 bits; the box of the range fit is a candidate as well, so that no block is worse
    than by it. Without three, all blocks have four colours, as BC2 and BC3 need. Weighted, a texel counts by its alpha.
    """

    def work(e: np.ndarray) -> dict[str, pa.Array]:
        c, error, box = block_bytes(e, METRICS[metric], three, weighted, iterate)
        return {"c": pa.array(list(c), pa.list_(pa.int64())), "error": pa.array(error), "box_error": pa.array(box)}

    own = blocks.select(*keys, "e")
    return own.mapInArrow(lambda batches: in_steps(batches, keys, work), f"{shape(own, keys)}, c array<long>, error long, box_error long")


@lru_cache
def masks() -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """The 64 + 64 partitions as (subsets, partition); (subset, texel) of all of them; and each subset's place in the list."""
    some = [(2, p, [[m >> t & 1 for t in range(16)]]) for p, m in enumerate(partitions.TWO)]
    some += [(3, p, [[m >> t & 1 for t in range(16)], [m >> 16 + t & 1 for t in range(16)]]) for p, m in enumerate(partitions.THREE)]
    each, owner = [], []
    for at, (_, _, rest) in enumerate(some):
        rest = np.array(rest)
        each += [1 - rest.sum(0), *rest]
        owner += [at] * (len(rest) + 1)
    return [(n, p) for n, p, _ in some], np.array(each, np.int64), np.array(owner)


def least_errors(x: np.ndarray, members: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """(blocks, partitions): what no fit of a line to each subset can be below, from sums by mask alone.

    A subset's scatter has its trace as the error of its mean; a line takes away its greatest eigenvalue, which is no
    more than the root of the sum of all squared entries.
    """
    x, m, n = x.astype(np.float64), members.T.astype(np.float64), members.sum(1)
    s = np.einsum("bti,tm->bmi", x, m)
    q = np.einsum("btk,tm->bmk", (x[:, :, :, None] * x[:, :, None, :]).reshape(len(x), 16, 9), m)
    scatter = q - (s[:, :, :, None] * s[:, :, None, :]).reshape(*q.shape) / n[:, None]
    bound = np.maximum(scatter[:, :, [0, 4, 8]].sum(2) - np.sqrt((scatter * scatter).sum(2)), 0)
    return np.stack([bound[:, owner == k].sum(1) for k in range(owner[-1] + 1)], 1)


def best_partitions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(place of the best partition, its error, how many were fitted): least bound first, until no bound is below the best error."""
    _, members, owner = masks()
    bound = least_errors(x, members, owner) * QUARTER[0] ** 2 * (1 - 1e-9) - 1e-3
    order = np.argsort(bound, axis=1, kind="stable")
    best, at, looked = np.full(len(x), np.inf), np.zeros(len(x), np.int64), 0
    active = np.arange(len(x))
    for rank in range(order.shape[1]):
        own = order[active, rank]
        active = active[bound[active, own] <= best[active]]  # the next bounds are no less
        if not len(active):
            break
        own, looked = order[active, rank], looked + len(active)
        error = np.zeros(len(active))
        for subset in range(3):
            has = np.flatnonzero(np.bincount(owner)[own] > subset)
            mask = members[np.searchsorted(owner, own[has]) + subset]
            w = mask.astype(np.int64)
            one = w.sum(1) == 1  # a texel by itself is met exactly
            found, _ = best_split(x[active[has]], w, principal_axis(x[active[has]], w), QUARTER, FULL_BITS, (1, 1, 1))
            error[has] += np.where(one, 0, found)
        better = (error < best[active]) | ((error == best[active]) & (own < at[active]))
        best[active[better]], at[active[better]] = error[better], own[better]
    return at, best, looked


def partition_fit(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, subsets, partition, error): the partition whose subsets, each fitted by clusters of its own, leave the least error.

    Ends have 8 bits, levels are 0, 21, 43 and 64 in 64; the error is in squares of 64ths. All 128 partitions are ranked
    by bounds from sums over their masks, and only those are fitted whose bound does not pass the best error so far. The
    fewer subsets, then the lower number, counts among equals.
    """

    def work(e: np.ndarray) -> dict[str, pa.Array]:
        at, error, _ = best_partitions(e[:, :, :3])
        names = np.array(masks()[0])[at]
        return {"subsets": pa.array(names[:, 0]), "partition": pa.array(names[:, 1]), "error": pa.array(error.astype(np.int64))}

    own = blocks.select(*keys, "e")
    return own.mapInArrow(lambda batches: in_steps(batches, keys, work), f"{shape(own, keys)}, subsets long, partition long, error long")
