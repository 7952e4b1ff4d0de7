"""Removal of repeated byte strings: anchored suffixes, sorted by mergesort through their common extensions."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, removed, scratch, shuffles_removed, stored

#: Bytes of a string that counts as repeated, and of the grams of which each string's least hash is its anchor.
LENGTH, GRAM = 50, 24
#: Bytes of text of a block, per bucket, and that are hashed together; strings that are sorted together. Blocks and buckets
#: exchange a row each, so that rows are as many as the square of the text over BLOCK * BUCKET: these are as large as memory lets
#: them be, and a row costs little.
BLOCK, BUCKET, STEP, SORTED = 3 << 20, 10 << 20, 1 << 18, 60_000
#: Bytes of stretches that are compared together.
LOT = 1 << 20
#: A gram with more different surroundings than this is dealt by the strings around it instead of by itself.
HOT = 1024
#: Added to the anchor's place of a string that is dealt by itself.
ALONE = 128
BASE, SPREAD = 0x5851F42D4C957F2D, np.uint64(0x9E3779B97F4A7C15)
INVERSE = pow(BASE, -1, 1 << 64)
NOBODY = np.iinfo(np.int64).max


KNOWN: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2^64; they are kept for the next call."""
    if base not in KNOWN or len(KNOWN[base]) < n:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        KNOWN[base] = np.cumprod(out, dtype=np.uint64)
    return KNOWN[base][:n]


class Hashes:
    """Polynomial prefix hashes modulo 2^64 of a byte array; the hash of any substring follows from two of them."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.data, self.down = data, powers(INVERSE, n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= powers(BASE, n + 1)[:n]
        np.cumsum(terms, out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * SPREAD
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The hashes of the grams at these places, a byte of all of them at a time, mixed twice.

    Anchors are the grams of least hash once mixed; mixed again they spread evenly over buckets.
    """
    out = np.zeros(len(place), np.uint64)
    for k, x in enumerate(powers(BASE, GRAM)):
        out += (data[place + k].astype(np.uint64) + np.uint64(1)) * x
    return mixed(mixed(out))


def stretch_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hashes of these stretches, each of less than 128 bytes; the prefix hashes are those of a piece at a time."""
    out = np.empty(len(start), np.uint64)
    order = np.argsort(start // STEP, kind="stable")
    edge = np.searchsorted(start[order] // STEP, np.arange(len(data) // STEP + 2))
    for k, (s, e) in enumerate(zip(edge, edge[1:])):
        if s < e:
            some, at = order[s:e], k * STEP
            begin = start[some] - at
            out[some] = Hashes(data[at : at + STEP + 127]).of(begin, begin + size[some])
    return out


@dataclass(frozen=True)
class Runs:
    """Neighbouring strings with the same anchor, a gram in them.

    first: where the first one starts; strings: how many; offset: where in the first one the gram stands; gram, whole:
    hashes of the gram and of all the bytes.
    """

    first: np.ndarray
    strings: np.ndarray
    offset: np.ndarray
    gram: np.ndarray
    whole: np.ndarray


def runs(data: np.ndarray, lengths: np.ndarray) -> Runs:
    """All strings of LENGTH bytes within each document. Equal strings have the same anchor at the same place in them."""
    width = LENGTH - GRAM + 1
    upto = np.cumsum(lengths)
    parts = [(np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for at in range(0, len(data) - LENGTH + 1, STEP):
        piece = Hashes(data[at : at + STEP + LENGTH - 1])
        start = np.arange(len(piece.data) - GRAM + 1)
        gram = mixed(piece.of(start, start + GRAM))
        low = np.uint64((1 << 20) - 1)
        least, span = (gram & ~low) | start.astype(np.uint64), 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        place = (least & low).astype(np.int64)
        ends = np.unique(upto[np.searchsorted(upto, at, side="right") : np.searchsorted(upto, at + len(place) + LENGTH)]) - at
        over = (ends[:, None] - np.arange(1, LENGTH)).ravel()  # strings that begin here reach beyond a document's end
        place[over[(over >= 0) & (over < len(place))]] = -1
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        strings = np.diff(np.append(first, len(place)))
        kept = place[first] >= 0
        first, strings = first[kept], strings[kept]
        parts.append(((first + at).astype(np.int32), strings.astype(np.uint8), (place[first] - first).astype(np.uint8), mixed(gram[place[first]]), piece.of(first, first + strings + LENGTH - 1)))
    return Runs(*(np.concatenate(x) for x in zip(*parts)))


#: One of each for a process: blocks times buckets values pass through them, most of them small.
COMPRESSOR, DECOMPRESSOR = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    return COMPRESSOR.compress(b"".join([struct.pack(f"<{len(arrays)}q", *[a.nbytes for a in arrays]), *[a.tobytes() for a in arrays]]))


def unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    raw, out, at = DECOMPRESSOR.decompress(blob), [], 8 * len(types)
    for n, t in zip(struct.unpack_from(f"<{len(types)}q", raw), types):
        out.append(np.frombuffer(raw[at : at + n], t))  # a copy, so that numbers are aligned
        at += n
    return out


BLOCKS = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("size", pa.int64()), ("data", pa.binary())])


def blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_id, size, data): whole texts as bytes, some MB in a row; null is empty."""

    def run(batches):
        part, number, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            lengths, data = np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8)
            return batch(BLOCKS, block=[part << 32 | number], doc_id=[ids], size=[size], data=[pack(lengths, data)])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size >= BLOCK:
                    yield flush()
                    number, ids, texts, size = number + 1, [], [], 0
            pa.default_memory_pool().release_unused()
        if ids:
            yield flush()

    return docs.select("doc_id", F.col("text").cast("binary").alias("_text")).mapInArrow(run, "block long, doc_id array<long>, size long, data binary")


def given_back(table: pa.Table) -> pa.Table:
    """The table, after the allocator has handed what it keeps for later back to the machine."""
    pa.default_memory_pool().release_unused()
    return table


def groups_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group starts in it.

    Several keys are sorted by a hash of them all; where different ones share a hash, all are sorted key by key.
    """
    h = keys[0].astype(np.uint64)
    for k in keys[1:]:
        h = mixed(h) + k.astype(np.uint64)
    for order in (np.argsort(h), None):
        order = np.lexsort(keys) if order is None else order
        new = np.zeros(len(order), bool)
        new[:1] = True
        for k in keys:
            some = k[order]
            new[1:] |= some[1:] != some[:-1]
        some = h[order]
        if not (new[1:] & (some[1:] == some[:-1])).any():
            break
    return order, np.flatnonzero(new)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n buckets, equal ranges of all hashes, each hash is in."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def cuts(sorted_buckets: np.ndarray) -> list[tuple[int, int]]:
    edge = [0, *(np.flatnonzero(np.diff(sorted_buckets)) + 1).tolist(), len(sorted_buckets)] if len(sorted_buckets) else [0]
    return list(zip(edge, edge[1:]))


def run_docs(lengths: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.cumsum(lengths), start, side="right")


def distinct_grams(found: Runs, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams in order, whether several documents of the block have each, and how many surroundings each has.

    Surroundings are counted by the power of two that is not below their number.
    """
    order, begin = groups_of(found.gram)
    if not len(order):
        return found.gram, np.zeros(0, bool), np.zeros(0, np.uint8)
    own, n = doc[order], np.diff(np.append(begin, len(order)))
    number, around = np.repeat(np.arange(len(begin)), n), np.ones(len(begin), np.int64)
    again = np.repeat(n > 1, n)
    number, whole = number[again], found.whole[order[again]]
    first = (o := groups_of(number, whole))[0][o[1]]
    around[n > 1] = np.bincount(number[first], minlength=len(begin))[n > 1]
    return found.gram[order[begin]], np.minimum.reduceat(own, begin) < np.maximum.reduceat(own, begin), np.ceil(np.log2(around)).astype(np.uint8)


def shared_grams(texts: DataFrame, buckets: int, hot_from: int = HOT) -> DataFrame:
    """(flag_of, bucket, n, shared, hot): for each block, of its distinct grams in order, which other documents have too.

    A hot gram has more surroundings than hot_from, each block's counted by themselves.
    """

    def emit(batches):
        shape = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("grams", pa.binary()), ("several", pa.binary()), ("around", pa.binary())])
        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(1)):
                lengths, data = unpack(blob.as_py(), np.int64, np.uint8)
                found = runs(data, lengths)
                grams, several, around = distinct_grams(found, run_docs(lengths, found.first))
                bucket = bucket_of(grams, buckets)
                some = cuts(bucket)
                low, near = grams.astype(np.uint32).tobytes(), around.tobytes()
                packed = [low[4 * s : 4 * e] for s, e in some], [np.packbits(several[s:e]).tobytes() for s, e in some], [near[s:e] for s, e in some]
                yield batch(shape, bucket=[int(bucket[s]) for s, _ in some], block=[block] * len(some), grams=packed[0], several=packed[1], around=packed[2])

    def meet(rows: pa.Table) -> pa.Table:
        grams = [np.frombuffer(x, np.uint32) for x in rows.column("grams").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(g)) for x, g in zip(rows.column("several").to_pylist(), grams)]
        around = np.frombuffer(b"".join(rows.column("around").to_pylist()), np.uint8)
        _, place, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        inside = np.bincount(place, weights=np.concatenate(several), minlength=len(count)) > 0
        many = np.bincount(place, weights=np.exp2(around, dtype=np.float64), minlength=len(count)) > hot_from
        edge = np.cumsum([0, *map(len, grams)])
        shared, hot = ((count > 1) | inside)[place], many[place]
        bits_of = lambda x: pa.array([np.packbits(x[s:e]).tobytes() for s, e in zip(edge, edge[1:])], pa.binary())
        return given_back(pa.table({"flag_of": rows.column("block"), "bucket": rows.column("bucket"), "n": pa.array([len(g) for g in grams], pa.int64()), "shared": bits_of(shared), "hot": bits_of(hot)}))

    asked = texts.select("block", "data").mapInArrow(emit, "bucket long, block long, grams binary, several binary, around binary")
    return asked.groupBy("bucket").applyInArrow(meet, "flag_of long, bucket long, n long, shared binary, hot binary")


def byte_places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all bytes of these stretches, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)


def same_bytes(data: np.ndarray, p: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches of these sizes at p and q are the same, byte for byte; a bounded number of bytes at a time."""
    out, total, at = np.zeros(len(size), bool), np.cumsum(size), 0
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, side="right")))
        some = size[at:upto]
        differ = data[byte_places(p[at:upto], some)] != data[byte_places(q[at:upto], some)]
        out[at:upto] = np.add.reduceat(differ, np.cumsum(some) - some, dtype=np.int64) == 0
        at = upto
    return out


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that sorts as they do; zeros follow the end."""
    out = np.zeros(len(data), np.uint64)
    for k in range(min(8, len(data))):
        out[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def suffix_sort(hashes: Hashes, place: np.ndarray, group: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes at these places by their first bytes, length of them, within each group.

    Groups lie together, and all suffixes of one have the same length. Returns the order and, for each sorted suffix,
    whether it differs from the one before it. A bottom-up mergesort: every suffix finds its rank in the neighbouring
    run by binary search, each comparison going through their common extension by eight bytes at a time. Of suffixes with
    equal hashes one takes part for all, and they are then verified byte for byte; where hashes have lied, that group is
    sorted by its bytes.
    """
    data, n = hashes.data, len(place)
    edges = lambda group: np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    all_begin = edges(group)
    all_size = np.diff(np.append(all_begin, n))
    group = np.repeat(np.arange(len(all_begin)), all_size)
    all_whole = hashes.of(place, place + length)
    member, first = groups_of(group, all_whole)
    held = np.diff(np.append(first, n))
    in_order = np.argsort(group[member[first]], kind="stable")
    first, held = first[in_order], held[in_order]
    head = member[first]
    whole, all_place, all_length = all_whole[head], place, length
    place, length = place[head], length[head]
    order = np.arange(len(head))
    begin = edges(group[head])
    size = np.diff(np.append(begin, len(head)))
    start, end = np.repeat(begin, size), np.repeat(begin + size, size)

    def compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1."""
        out = np.zeros(len(a), np.int8)
        other = np.flatnonzero(whole[a] != whole[b])
        p, q = place[a[other]], place[b[other]]
        while len(other):  # their hashes differ, so that their bytes do before they end
            x, y = words[p], words[q]
            out[other] = np.where(x < y, -1, 1)
            equal = np.flatnonzero(x == y)
            other, p, q = other[equal], p[equal] + 8, q[equal] + 8
        return out

    width, words = 1, eights(data) if len(head) > len(size) else None
    while len(size) and width < size.max():
        at = np.flatnonzero(end - start > width)
        pair = start[at] + (at - start[at]) // (2 * width) * (2 * width)
        middle, stop = np.minimum(pair + width, end[at]), np.minimum(pair + 2 * width, end[at])
        left = at < middle
        low, high = np.where(left, middle, pair), np.where(left, stop, middle)
        base = low.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) // 2
            sign = compare(order[mid], order[at[open_]])
            before = (sign < 0) | ((sign == 0) & ~left[open_])
            low[open_[before]] = mid[before] + 1
            high[open_[~before]] = mid[~before]
            open_ = open_[low[open_] < high[open_]]
        own = np.where(left, at - pair, at - middle)
        merged = order.copy()
        merged[pair + own + (low - base)] = order[at]
        order = merged
        width *= 2
    order = member[byte_places(first[order], held[order])]
    place, length, whole = all_place, all_length, all_whole
    start, end = np.repeat(all_begin, all_size), np.repeat(all_begin + all_size, all_size)
    new = np.ones(n, bool)
    new[1:] = (group[1:] != group[:-1]) | (whole[order[1:]] != whole[order[:-1]])
    same = np.flatnonzero(~new)
    lied = same[~same_bytes(data, place[order[same]], place[order[same - 1]], length[same])]
    for g in np.unique(start[lied]):
        own = slice(g, end[g])
        text = [data[p : p + k].tobytes() for p, k in zip(place[order[own]], length[own])]
        by_bytes = sorted(range(len(text)), key=text.__getitem__)
        order[own] = order[own][by_bytes]
        new[own] = [k == 0 or text[by_bytes[k]] != text[by_bytes[k - 1]] for k in range(len(text))]
    return order, new


def lots(group: np.ndarray, size: np.ndarray, most: int):
    """What the arrays tell of in lots of a bounded sum of sizes, all those of a group in the same one."""
    order, begin = groups_of(group)
    end = np.append(begin[1:], len(order))
    total = np.cumsum(size[order])
    at = 0
    while at < len(begin):
        done = total[begin[at] - 1] if begin[at] else 0
        upto = max(at + 1, int(np.searchsorted(total[end - 1], done + most, side="right")))
        yield order[begin[at] : end[upto - 1]]
        at = upto


def leaders(data: np.ndarray, start: np.ndarray, size: np.ndarray, whole: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each stretch the first one that has the same keys and bytes.

    Hashes of all bytes deal stretches that can be equal side by side; suffix sorts of a bounded number of bytes tell
    which are. A group of any size is first sorted in parts, then what is left of each part together.
    """
    leader = np.arange(len(start))
    order, first = groups_of(*keys, size, whole)
    n = np.diff(np.append(first, len(order)))
    key = np.empty(len(order), np.int64)
    key[order] = np.repeat(np.arange(len(first)), n)

    def settle(some: np.ndarray) -> None:
        own = size[some]
        sorted_, new = suffix_sort(Hashes(data[byte_places(start[some], own)]), np.cumsum(own) - own, key[some], own)
        member, head = some[sorted_], np.flatnonzero(new)
        leader[member] = np.repeat(np.minimum.reduceat(member, head), np.diff(np.append(head, len(member))))

    todo = order[np.repeat(n > 1, n)]
    total, at = np.cumsum(size[todo]), 0
    while at < len(todo):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LOT, side="right")))
        settle(todo[at:upto])
        at = upto
    head = todo[leader[todo] == todo]
    head = head[np.bincount(key[head], minlength=1)[key[head]] > 1]
    if len(head):
        part = leader.copy()
        for some in lots(key[head], size[head], LOT):
            settle(head[some])
        leader = leader[part]
    return leader


CONTEXTS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int64()), ("first", pa.int64()), ("blob", pa.binary())])
CONTEXTS_SQL = "kind int, block long, bucket long, first long, blob binary"
PIECES, STRETCHES, ANSWERS, SINGLES, FOLDED = range(5)


def stretches_blobs(offset: np.ndarray, size: np.ndarray, least: np.ndarray, data: np.ndarray, start: np.ndarray, rows: list[tuple[int, int]]) -> list[bytes]:
    """The stretches of each row, from one to another (excluded), packed; their bytes are gathered a bounded number at a time."""
    end = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    own, at = np.empty(end[-1], np.uint8), 0
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(end, end[at] + STEP, side="right")) - 1)
        own[end[at] : end[upto]] = data[byte_places(start[at:upto], size[at:upto])]
        at = upto
    offset, size = offset.astype(np.uint8), size.astype(np.uint8)
    return [pack(offset[s:e], size[s:e], least[s:e], own[end[s] : end[e]]) for s, e in rows]


def contexts(texts: DataFrame, flags: DataFrame, buckets: int) -> DataFrame:
    """The stretches around shared grams, by bucket, the strings around hot ones, and where in the block each occurs."""

    def run(block: pa.Table, flags: pa.Table) -> pa.Table:
        out = []
        flags = flags.sort_by("bucket")
        size = flags.column("n").to_pylist()
        bits_of = lambda name: np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(flags.column(name).to_pylist(), size))]).astype(bool)
        shared, hot = bits_of("shared"), bits_of("hot")
        for row in block.to_pylist():
            lengths, data = unpack(row["data"], np.int64, np.uint8)
            ids = np.array([NOBODY if i is None else i for i in row["doc_id"]], np.int64)
            found = runs(data, lengths)
            grams, place = np.unique(found.gram, return_inverse=True)
            keep = np.flatnonzero(shared[place]) if len(place) else np.zeros(0, np.int64)
            apart = hot[place[keep]]
            whole_ones, alone = keep[~apart], keep[apart]
            # strings around a hot gram each go alone
            n = found.strings[alone].astype(np.int64)
            each = byte_places(found.first[alone].astype(np.int64), n)
            offset = np.repeat(found.offset[alone].astype(np.int64) + found.first[alone], n) - each + ALONE
            first = np.concatenate([found.first[whole_ones].astype(np.int64), each])
            strings = np.concatenate([found.strings[whole_ones], np.ones(len(each), np.uint8)])
            offset = np.concatenate([found.offset[whole_ones], offset.astype(np.uint8)])
            single = stretch_hashes(data, each, np.full(len(each), LENGTH))
            whole, route = np.concatenate([found.whole[whole_ones], single]), np.concatenate([found.gram[whole_ones], mixed(single)])
            stretch = strings.astype(np.int64) + LENGTH - 1
            leader = leaders(data, first, stretch, whole, route, offset)
            lead = np.flatnonzero(leader == np.arange(len(leader)))
            kind = np.where(offset[lead] >= ALONE, SINGLES, STRETCHES)
            bucket = bucket_of(route[lead], buckets)
            order = np.lexsort((bucket, kind))
            lead, kind, bucket = lead[order], kind[order], bucket[order]
            number = np.empty(len(leader), np.int64)
            number[lead] = np.arange(len(lead))
            number = number[leader]
            least = np.full(len(lead), NOBODY)
            np.minimum.at(least, number, ids[run_docs(lengths, first)])
            some = cuts(bucket + (kind == SINGLES) * (1 << 40))
            at = [s for s, _ in some]
            blobs = [pack(np.diff(first, prepend=0).astype(np.int32), number.astype(np.int32), strings, least)]
            blobs += stretches_blobs(offset[lead], stretch[lead], least, data, first[lead], some)
            # all rows in one batch: there are as many as buckets
            out.append(batch(CONTEXTS, kind=[PIECES, *kind[at].tolist()], block=[row["block"]] * len(blobs), bucket=[-1, *bucket[at].tolist()], first=[0, *at], blob=blobs))
        return given_back(pa.Table.from_batches(out, CONTEXTS))

    return texts.select("block", "doc_id", "data").groupBy("block").cogroup(flags.groupBy("flag_of")).applyInArrow(run, CONTEXTS_SQL)


@dataclass(frozen=True)
class Stretches:
    """The stretches of some rows, one after the other; cut: where each row's begin."""

    offset: np.ndarray
    size: np.ndarray
    least: np.ndarray
    data: np.ndarray
    start: np.ndarray
    cut: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Stretches:
        parts = [unpack(x, np.uint8, np.uint8, np.int64, np.uint8) for chunk in rows.column("blob").iterchunks() for x in chunk.to_pylist()]
        offset, size, least, data = (np.concatenate(x) for x in zip(*parts))
        size = size.astype(np.int64)
        return Stretches(offset, size, least, data, np.cumsum(size) - size, np.cumsum([0, *(len(p[0]) for p in parts)]))

    def met(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What deals each stretch (its gram, or itself), its leader, and the least document id of each leader's."""
        whole = stretch_hashes(self.data, self.start, self.size)
        alone = self.offset >= ALONE
        route = np.where(alone, mixed(whole), gram_hashes(self.data, self.start + self.offset % ALONE))
        leader = leaders(self.data, self.start, self.size, whole, route, self.offset)
        held = np.full(len(leader), NOBODY)
        np.minimum.at(held, leader, self.least)
        return route, leader, held


def least_holders(x: Stretches, route: np.ndarray, lead: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, ...]:
    """(stretch, first string, strings, least document id) for all strings of the different stretches `lead`.

    Where a gram has one stretch only, that has all strings; else the suffixes of all strings around it are sorted.
    """
    strings = x.size[lead] - LENGTH + 1
    _, place, n = np.unique(route[lead], return_inverse=True, return_counts=True)
    lone, several = lead[n[place] == 1], lead[n[place] > 1]
    out = [(lone, np.zeros(len(lone), np.int64), x.size[lone] - LENGTH + 1, held[lone])]
    for some in lots(route[several], x.size[several] - LENGTH + 1, SORTED):
        some = several[some]
        size = x.size[some]
        n, start = size - LENGTH + 1, np.cumsum(size) - size
        place, owner = byte_places(start, n), np.repeat(np.arange(len(some)), n)
        number = place - start[owner]
        inside = x.offset[some][owner].astype(np.int64) - number  # where the gram stands in the string
        together, begins = groups_of(route[some][owner], inside)
        group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(together))))
        sorted_, new = suffix_sort(Hashes(x.data[byte_places(x.start[some], size)]), place[together], group, np.full(len(together), LENGTH))
        member, equal = together[sorted_], np.flatnonzero(new)
        low = np.minimum.reduceat(held[some][owner[member]], equal)
        result = np.empty(len(place), np.int64)
        result[member] = np.repeat(low, np.diff(np.append(equal, len(member))))
        begin = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (result[1:] != result[:-1])]))
        out.append((some[owner[begin]], number[begin], np.diff(np.append(begin, len(result))), result[begin]))
    return tuple(np.concatenate(y) for y in zip(*out))


def joined(of: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each asked number, in order, the places in `of` that hold it: (place, which was asked)."""
    order = np.argsort(of, kind="stable")
    low, high = np.searchsorted(of[order], asked), np.searchsorted(of[order], asked, side="right")
    return order[byte_places(low, high - low)], np.repeat(np.arange(len(asked)), high - low)


def answers(stretches: DataFrame) -> DataFrame:
    """For each row's stretches, those strings that a document with a smaller id than the row's own holders has."""

    def meet(rows: pa.Table) -> pa.Table:
        x = Stretches.of(rows)
        route, leader, held = x.met()
        of, at, length, holder = least_holders(x, route, np.flatnonzero(leader == np.arange(len(leader))), held)
        reply, member = joined(of, leader)
        useful = holder[reply] < x.least[member]
        reply, member = reply[useful], member[useful]
        cut = np.searchsorted(member, x.cut)
        told = np.flatnonzero(cut[1:] > cut[:-1])  # what has no answer gets no row
        some = rows.select(["block", "bucket", "first"]).take(told)
        blobs = [pack((member[s:e] - f + r).astype(np.int32), at[reply[s:e]].astype(np.uint8), length[reply[s:e]].astype(np.uint8), holder[reply[s:e]]) for s, e, f, r in zip(cut[told], cut[told + 1], x.cut[told], some.column("first").to_pylist())]
        return given_back(pa.Table.from_batches([batch(CONTEXTS, kind=[ANSWERS] * len(blobs), **{c: some.column(c).combine_chunks() for c in some.column_names}, blob=blobs)]))

    return stretches.groupBy("bucket").applyInArrow(meet, CONTEXTS_SQL)


def folded(singles: DataFrame, folds: int) -> DataFrame:
    """Strings around hot grams of several blocks as one row for each bucket and fold, and where each block's went.

    So a string that all blocks hold meets itself in two steps, of as many folds and as many blocks of a fold.
    """

    def meet(rows: pa.Table) -> pa.Table:
        x = Stretches.of(rows)
        _, leader, held = x.met()
        lead = np.flatnonzero(leader == np.arange(len(leader)))
        number = np.empty(len(leader), np.int32)
        number[lead] = np.arange(len(lead))
        name = -1 - rows.column("_fold")[0].as_py()
        where = pack(np.array(rows.column("block")), np.array(rows.column("first")), np.diff(x.cut), number[leader], x.least, held[lead])
        bucket = rows.column("bucket")[0].as_py()
        return given_back(pa.Table.from_batches([batch(CONTEXTS, kind=[STRETCHES, FOLDED], block=[name] * 2, bucket=[bucket] * 2, first=[0, 0], blob=[*stretches_blobs(x.offset[lead], x.size[lead], held[lead], x.data, x.start[lead], [(0, len(lead))]), where])]))

    dealt = singles.withColumn("_fold", F.pmod(F.xxhash64("block"), F.lit(folds)))
    return dealt.groupBy("bucket", "_fold").applyInArrow(meet, CONTEXTS_SQL)


def unfolded(where: DataFrame, replies: DataFrame) -> DataFrame:
    """What was answered to folds, as answers to their blocks."""

    def run(where: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for row in where.to_pylist():
            block, first, n, number, least, held = unpack(row["blob"], np.int64, np.int64, np.int64, np.int32, np.int64, np.int64)
            held = held.copy()
            for x in told.column("blob"):
                of, _, _, holder = unpack(x.as_py(), np.int32, np.uint8, np.uint8, np.int64)
                held[of] = holder
            member = np.flatnonzero(held[number] < least)
            edge = np.cumsum(np.concatenate([[0], n]))
            cut = np.searchsorted(member, edge)
            some = np.flatnonzero(cut[1:] > cut[:-1])
            blobs = [pack((member[s:e] - f + r).astype(np.int32), np.zeros(e - s, np.uint8), np.ones(e - s, np.uint8), held[number[member[s:e]]]) for s, e, f, r in zip(cut[some], cut[some + 1], edge[some], first[some])]
            out.append(batch(CONTEXTS, kind=[ANSWERS] * len(blobs), block=block[some], bucket=[row["bucket"]] * len(blobs), first=first[some], blob=blobs))
        return given_back(pa.Table.from_batches(out, CONTEXTS))

    told = replies.select(F.col("block").alias("_of"), F.col("bucket").alias("_in"), "blob")
    return where.groupBy("block", "bucket").cogroup(told.groupBy("_of", "_in")).applyInArrow(run, CONTEXTS_SQL)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def gone_bytes(lengths: np.ndarray, ids: list, pieces: bytes | None, replies: list[bytes]) -> np.ndarray:
    """Which bytes of a block go."""
    change = np.zeros(int(lengths.sum()) + 1, np.int32)
    if pieces is not None:
        first, number, strings, least = unpack(pieces, np.int32, np.int32, np.uint8, np.int64)
        first = np.cumsum(first, dtype=np.int64)
        own = np.array([np.iinfo(np.int64).min if i is None else i for i in ids], np.int64)[run_docs(lengths, first)] if len(first) else np.zeros(0, np.int64)
        local = np.flatnonzero(least[number] < own)
        np.add.at(change, first[local], 1)
        np.add.at(change, first[local] + strings[local].astype(np.int64) + LENGTH - 1, -1)
        said = [unpack(x, np.int32, np.uint8, np.uint8, np.int64) for x in replies]
        of, at, length, holder = (np.concatenate([p[k] for p in said]) for k in range(4)) if said else (np.zeros(0, np.int64),) * 4
        order = np.argsort(of, kind="stable")
        of, at, length, holder = of[order], at[order].astype(np.int64), length[order].astype(np.int64), holder[order]
        low, high = np.searchsorted(of, number), np.searchsorted(of, number, side="right")
        reply, piece = byte_places(low, high - low), np.repeat(np.arange(len(number)), high - low)
        smaller = holder[reply] < own[piece]
        reply, piece = reply[smaller], piece[smaller]
        np.add.at(change, first[piece] + at[reply], 1)
        np.add.at(change, first[piece] + at[reply] + length[reply] + LENGTH - 1, -1)
    return np.cumsum(change)[:-1] > 0


def deduplicated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: each whole text without bytes in repeated strings.

    A byte goes if a string of LENGTH bytes around it also starts in a document with a smaller doc_id. Every string
    has an anchor, the gram in it of least hash, so equal strings meet through their anchors: these only deal the work.
    First it is found which grams several documents hold; then stretches of text around those, some 65 bytes each, meet
    by gram, and mergesorts of suffixes tell which of them, and which strings of different ones, are equal. A gram with
    very many surroundings is not gathered: the strings around it are dealt by themselves, in two steps, so that
    neither a gram nor a string gathers what grows with the corpus in one task.

    Null texts are empty. Rows with the same doc_id take nothing from each other; a null doc_id neither takes nor gives.
    Texts shorter than a string stay whole; a text of many megabytes is a block of its own. An empty table gives an
    empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    texts = stored(blocks(docs), "blocks")
    total, n = texts.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    buckets = total // BUCKET + 1
    with shuffles_removed(spark), scratch() as keep:
        flags = stored(shared_grams(texts, buckets, hot), "flags")
        made = keep(stored(contexts(texts, flags, buckets), "contexts"))
        removed(flags)
        folds = stored(folded(made.where(F.col("kind") == SINGLES), math.isqrt(n) + 1), "folds")
        replies = keep(stored(answers(made.where(F.col("kind") == STRETCHES).unionByName(folds.where(F.col("kind") == STRETCHES))), "answers"))
        told = keep(stored(unfolded(folds.where(F.col("kind") == FOLDED), replies.where("block < 0")), "unfolded"))
    replies = replies.where("block >= 0").unionByName(told)
    both = made.where(F.col("kind") == PIECES).unionByName(replies).select(F.col("block").alias("_block"), "kind", "blob")

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        kinds, blobs = told.column("kind").to_pylist(), told.column("blob").to_pylist()
        out = []
        for row in block.to_pylist():
            lengths, data = unpack(row["data"], np.int64, np.uint8)
            gone = gone_bytes(lengths, row["doc_id"], next((x for k, x in zip(kinds, blobs) if k == PIECES), None), [x for k, x in zip(kinds, blobs) if k == ANSWERS])
            counts, spans, kept, at = [], [], [], 0
            for n in lengths.tolist():
                own = gone[at : at + n]
                counts.append(int(own.sum()))
                spans.append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if counts[-1] else 0)
                kept.append(data[at : at + n][~own].tobytes() if counts[-1] else data[at : at + n].tobytes())
                at += n
            out.append(batch(RESULT, doc_id=row["doc_id"], n_bytes=lengths, n_removed=counts, n_spans=spans, kept=kept))
        return given_back(pa.Table.from_batches(out, RESULT))

    return texts.groupBy("block").cogroup(both.groupBy("_block")).applyInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
