"""Near-duplicates by SimHash, linked through meet-in-the-middle ball hashing."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, removed, scratch, set_aside, shuffles_removed, stored, with_row_index
from .components import components

#: Fingerprints whose variants are made at a time, and variants that a bucket holds on average.
AT_ONCE, PER_BUCKET = 2048, 1 << 20
#: Variants of one pass; beyond this the space of variants is cut in up to MOST_PASSES parts, one after the other, so
#: that the disk holds no more than that share of them at a time. Links are the same either way.
PER_PASS, MOST_PASSES = 1 << 24, 8
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Variants fall into parts by three parities over these bits: linear, so a part's masks follow from a fingerprint's part.
PARITIES = (0x9249249249249249, 0xC30C30C30C30C30C, 0xF0F00F0FA55AA55A)
#: Share of common shingles from which texts are near-duplicates in the pipeline.
SIMILAR = 0.8
#: Least hashes under BANDS x BAND permutations: a pair at SIMILAR agrees in all of some band but for (1 - 0.8^4)^32 < 5e-8.
BANDS, BAND = 32, 4
SALTS, FACTORS, MIXERS = np.random.default_rng(64).integers(0, 1 << 64, (3, BANDS * BAND), dtype=np.uint64) | np.array([[0], [1], [1]], dtype=np.uint64)
#: Shingles whose permuted hashes are in memory at a time; bytes of text that are hashed together.
PERMUTED, LOT = 2048, 1 << 20
#: Least hashes in which texts at SIMILAR agree but for a chance below 1e-7 (102 of 128 on average).
ALIKE = 75
#: Bits of a set's parities: in each the number of shingles that fall on it, odd or even.
PARITIES_OF_SET = 1024
#: Rounds in which a bucket's texts meet one of them; texts of a part of a bucket.
STARS, CELL = 3, 2048
GAP = re.compile(rb"[\x20\x09-\x0D]")


def shingle_lots(text: bytes | None, width: int) -> Iterator[np.ndarray]:
    """The hash of each shingle of so many words, repeats included, those of some LOT bytes of text at a time.

    A text of fewer words has one of all words; one without words none.
    """
    text, at, words, none = (text or b"").lower(), 0, [], True
    digest = xxhash.xxh64_intdigest
    while at < len(text):
        end = m.end() if (m := GAP.search(text, at + LOT)) else len(text)
        words = [*words[1 - width :], *text[at:end].split()] if width > 1 else text[at:end].split()
        at = end
        if len(words) >= width or (at == len(text) and none and words):
            line, ends, e = b" ".join(words), [], -1
            for w in words:
                ends.append(e := e + len(w) + 1)
            starts = [0, *(x + 1 for x in ends[:-1])]
            yield np.array([digest(line[s:e], 42) for s, e in zip(starts, ends[min(width, len(words)) - 1 :])], dtype=np.uint64)
            none = False


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The different hashes of a text's shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(np.unique(x) for x in shingle_lots(text, width))]))


def fingerprint(lots: Iterable[np.ndarray]) -> int:
    """The 64-bit SimHash of a text's shingles; 0 without any."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in lots:
        for at in range(0, len(hashes), 65536):
            ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def least_hashes(distinct: np.ndarray) -> np.ndarray:
    """The least permuted hashes of a set of shingles (MinHash)."""
    least = np.full(BANDS * BAND, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(distinct), PERMUTED):
        least = np.minimum(least, ((distinct[at : at + PERMUTED, None] ^ SALTS) * FACTORS).min(0))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A hash of each band of the least hashes."""
    mixed = ((least ^ (least >> np.uint64(29))) * MIXERS).reshape(BANDS, BAND).sum(1, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(32))) * SPREAD + np.arange(BANDS, dtype=np.uint64)


def parities(distinct: np.ndarray) -> np.ndarray:
    """For each of some bits, whether an odd number of a set's shingles falls on it, packed.

    Sets that differ in n shingles differ in n of these bits at most.
    """
    return np.packbits(np.bincount((distinct >> np.uint64(32)).astype(np.int64) % PARITIES_OF_SET, minlength=PARITIES_OF_SET) % 2 == 1)


def alike(x: np.ndarray, y: np.ndarray, x_size: np.ndarray, y_size: np.ndarray, similar: float) -> np.ndarray:
    """Whether sets can be this similar by their sketches (rows of bytes) and sizes.

    Their least hashes agree in ALIKE places at least, as those of similar sets do but for 1 in 10^7; and they differ in
    no more shingles than similar sets of these sizes can, of which the parities are a lower bound.
    """
    n = BANDS * BAND
    apart = np.bitwise_count(np.ascontiguousarray(x[..., n:]).view(np.uint64) ^ np.ascontiguousarray(y[..., n:]).view(np.uint64)).sum(-1, dtype=np.int64)
    near = apart <= (x_size + y_size) * (1 - similar) / (1 + similar) + 1e-6
    near[near] = ((x if x.ndim == 1 else x[near])[..., :n] == y[near][:, :n]).sum(-1) >= ALIKE
    return near


def fingerprints(docs: DataFrame, carry: list[str], width: int, banded: bool = False) -> DataFrame:
    """The carried columns and the fingerprint `fp` of each text (a signed long).

    If banded, the set of its shingles follows: `key`, a hash of it, `size`, `bands`, and `sketch`, a byte of each least
    hash and the parities; no bands without words. Null texts are empty; a very long text is hashed in lots.
    """
    schema = docs.select(*carry).schema.add("fp", "long")
    names = [*carry, "fp"]
    if banded:
        schema = schema.add("key", "long").add("size", "long").add("bands", T.ArrayType(T.LongType())).add("sketch", "binary")
        names += ["key", "size", "bands", "sketch"]

    def run(batches):
        for b in batches:
            fp, key, size, some, sketch = [], [], [], [], []
            for t in b.columns[-1]:
                lots = list(shingle_lots(t.as_py(), width)) if banded else shingle_lots(t.as_py(), width)
                fp.append(fingerprint(lots))
                if banded:
                    distinct = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *lots]))
                    least = least_hashes(distinct)
                    key.append(xxhash.xxh64_intdigest(distinct.tobytes(), 7) - (1 << 63))
                    size.append(len(distinct))
                    some.append(bands(least).view(np.int64) if len(distinct) else [])
                    sketch.append(least.astype(np.uint8).tobytes() + parities(distinct).tobytes())
            more = [pa.array(key, pa.int64()), pa.array(size, pa.int64()), pa.array(some, pa.list_(pa.int64())), pa.array(sketch, pa.binary())] if banded else []
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp, pa.int64()), *more], names=names)

    return docs.select(*carry, F.col("text").cast("binary").alias("_text")).mapInArrow(run, schema)


def masks(radius: int) -> np.ndarray:
    """Every set of at most so many of 64 bits, as numbers."""
    return np.array([sum(1 << i for i in c) for n in range(radius + 1) for c in combinations(range(64), n)], dtype=np.uint64)


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    """The part of the variant space that each number lies in; parts is a power of two up to 8."""
    out = np.zeros(x.shape, dtype=np.uint8)
    for k in range(parts.bit_length() - 1):
        out |= (np.bitwise_count(x & np.uint64(PARITIES[k])) & 1) << k
    return out


def ball_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints `fp`; joined up they tie all pairs at most radius bits apart.

    Each fingerprint emits all variants within half the radius. Two fingerprints within the radius share a variant;
    those sharing one are within the radius of each other, so a variant's least fingerprint is linked to each other
    one and the group's pairs are never spelled out. Variants travel as blocks of numbers, dealt by a hash of the
    variant, so a bucket's size doesn't depend on how alike the fingerprints are. To spare the disk, the space of
    variants is cut into up to MOST_PASSES parts, and every part is one pass over the fingerprints.
    """
    spark = fps.sparkSession
    half = radius // 2 + radius % 2
    flips = masks(half)
    count = fps.count()
    parts = 1
    while parts < MOST_PASSES and count * len(flips) > parts * PER_PASS:
        parts *= 2
    bits = max(0, (count * len(flips) // parts // PER_BUCKET).bit_length())
    found = None
    for part in range(parts):

        def emit(batches, part=part):
            of = part_of(flips, parts)
            chosen = [np.flatnonzero(of == p) for p in range(parts)]
            shape = pa.schema([("bucket", pa.int64()), ("variants", pa.binary()), ("flips", pa.binary())])
            for b in batches:
                x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for at in range(0, len(x), AT_ONCE):
                    some = x[at : at + AT_ONCE]
                    home = part_of(some, parts)
                    v, m = [], []
                    for p in range(parts):
                        own, ids = some[home == p], chosen[p ^ part]
                        v.append((own[:, None] ^ flips[ids][None, :]).ravel())
                        m.append(np.broadcast_to(ids.astype(np.uint32), (len(own), len(ids))).ravel())
                    v, m = np.concatenate(v), np.concatenate(m)
                    bucket = ((v * SPREAD) >> np.uint64(64 - bits)).astype(np.uint32) if bits else np.zeros(len(v), np.uint32)
                    order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
                    v, m, bucket = v[order], m[order], bucket[order]
                    cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(v)] if len(v) else [0]
                    runs = list(zip(cut, cut[1:]))
                    yield batch(shape, bucket=[int(bucket[s]) for s, _ in runs], variants=[v[s:e].tobytes() for s, e in runs], flips=[m[s:e].astype(np.uint16 if len(flips) < 65536 else np.uint32).tobytes() for s, e in runs])

        def meet(rows: pa.Table) -> pa.Table:
            v = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in rows.column("variants")])
            m = np.concatenate([np.frombuffer(x.as_py(), np.uint16 if len(flips) < 65536 else np.uint32) for x in rows.column("flips")])
            order = np.argsort(v)
            v, f = v[order], (v ^ flips[m])[order].view(np.int64)
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            size = np.diff(np.append(first, len(v)))
            many = np.repeat(size > 1, size)
            low = np.repeat(np.minimum.reduceat(f, first), size)[many]
            f = f[many]
            near = (low != f) & (np.bitwise_count((low ^ f).view(np.uint64)) <= radius)
            pairs = np.stack([low[near], f[near]], 1)
            pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
            return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

        with shuffles_removed(spark):
            one = fps.select("fp").mapInArrow(emit, "bucket long, variants binary, flips binary")
            one = stored(one.groupBy("bucket").applyInArrow(meet, "a long, b long"), "links")
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def rows_of(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(len(sketches), -1)


def sketched(pairs: DataFrame, kept: DataFrame, similar: float) -> DataFrame:
    """Those of the pairs (a, b) that can be this similar by their sketches."""
    of = lambda end, name: kept.select(F.col("doc_id").alias(end), F.col("sketch").alias(name), F.col("size").alias(f"{name}_size"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                fits = alike(rows_of(b.column(2)), rows_of(b.column(3)), b.column(4).to_numpy(), b.column(5).to_numpy(), similar)
                yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(fits))

    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    return both.select("a", "b", "x", "y", "x_size", "y_size").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, width: int, similar: float) -> DataFrame:
    """Those of the stored pairs (a, b) of doc_ids whose sets of shingles have at least this Jaccard similarity."""
    named = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.columns[0], pa.array([shingles(t.as_py(), width).tobytes() for t in b.columns[1]], pa.binary())], names=["doc_id", "set"])

    def compared(batches):
        for b in batches:
            kept = []
            for x, y in zip(b.columns[2], b.columns[3]):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(common >= similar * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    of = docs.select("doc_id", F.col("text").cast("binary").alias("_text")).join(named, "doc_id", "left_semi")
    of = stored(of.mapInArrow(sets, "doc_id long, set binary"), "sets")
    left = pairs.join(of.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(of.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    found = stored(both.mapInArrow(compared, "a long, b long"), "verified")
    removed(of)
    return found


def close_pairs(apart: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of (band, doc_id, size, group, sketch) that share a band, are in different groups and alike by sketch.

    A bucket's rows meet in cells of two parts of bounded size, and a cell gives the pairs that are alike, not all.
    """
    parts = apart.groupBy("band").agg(F.ceil(F.count("*") / CELL).alias("_parts"))
    dealt = apart.join(parts, "band").withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.col("_parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
    dealt = dealt.withColumn("_other", other).select("band", "doc_id", "size", "group", "sketch", "_part", F.least("_part", "_other").alias("_low"), F.greatest("_part", "_other").alias("_high"))
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def cell(rows: pa.Table) -> pa.Table:
        ids, size, group, part, low, high = (rows.column(c).to_numpy() for c in ("doc_id", "size", "group", "_part", "_low", "_high"))
        sketch = rows_of(rows.column("sketch"))
        a, b = [], []
        for k in range(len(ids)):
            fits = (group != group[k]) & (ids > ids[k]) & (np.minimum(size, size[k]) >= np.maximum(size, size[k]) * similar - 1e-9)
            if low[0] != high[0]:
                fits &= part != part[k]
            some = np.flatnonzero(fits)
            some = some[alike(sketch[k], sketch[some], size[k], size[some], similar)]
            a.append(np.full(len(some), ids[k]))
            b.append(ids[some])
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=shape)

    return dealt.groupBy("band", "_low", "_high").applyInArrow(cell, "a long, b long").distinct()


def similar_links(kept: DataFrame, docs: DataFrame, width: int, similar: float) -> DataFrame:
    """Links (a, b) between doc_ids; joined up they tie all texts whose sets of shingles are this similar.

    Equal sets are linked to one of them, which stands for all. Of those, texts that share a band are candidates, and
    each pair that is alike by its sketches is compared by its shingles. For some rounds one text of each bucket meets
    those that are not joined up with it yet, another one by chance in each round, so that a large group of near copies
    becomes one without its pairs being spelled out, first the one that shares most; then what is still apart in a bucket
    meets in cells.
    """
    words = kept.where("size > 0")
    first = stored(words.groupBy("key").agg(F.min("doc_id").alias("rep")), "sets")
    same = words.join(first, "key").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    reps = words.join(first.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    each = reps.select("doc_id", "size", F.explode("bands").alias("band"))
    shared = stored(each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = stored(each.join(shared, "band"), "met")
    # a text of which others are copies shares its bands with most of them
    known = stored(met.groupBy("doc_id").agg(F.sum("n").alias("score")), "known")
    fits = F.least("size", "c.size") >= F.greatest("size", "c.size") * similar - 1e-9
    state, links = met.select("band", "doc_id", "size", F.col("doc_id").alias("group")), None
    for k in range(STARS + 1):
        order = -F.col("score") if k == 0 else F.xxhash64("doc_id", F.lit(k))
        centre = F.min(F.struct(order.alias("h"), "doc_id", "size", "group")).alias("c")
        apart = stored((state.join(known, "doc_id") if k == 0 else state).groupBy("band").agg(centre, F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("band", "c"), "apart")
        if apart.isEmpty():
            break
        before, met = met, stored(state.join(apart.select("band"), "band", "left_semi"), "met")
        removed(before)
        if k < STARS:
            pairs = met.join(apart, "band").where((F.col("group") != F.col("c.group")) & fits).select(F.col("doc_id").alias("a"), F.col("c.doc_id").alias("b")).distinct()
            near = stored(sketched(pairs, kept, similar), "alike")
        else:
            near = stored(close_pairs(met.join(kept.select("doc_id", "sketch"), "doc_id"), similar), "alike")
        found = verified(near, docs, width, similar)
        links = found if links is None else links.unionByName(found)
        if k < STARS:
            named = components(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).withColumnRenamed("node", "doc_id")
            state = met.select("band", "doc_id", "size").join(named, "doc_id", "left").select("band", "doc_id", "size", F.coalesce("component", "doc_id").alias("group"))
    return same if links is None else same.unionByName(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def near_duplicates(docs: DataFrame, width: int = 5, radius: int = 4, similar: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach from the document.

    Texts are linked whose fingerprints are at most radius bits apart; with similar, those as well whose shingles have
    at least this Jaccard similarity, for which a doc_id is neither null nor repeated. Null texts, and texts without
    words, have fingerprint 0 and are linked like any other. Repeated rows are rows of one group. A null doc_id takes
    part, but names no component: one with null ids only has a null component_id. An empty table gives an empty
    result; other columns are not looked at.
    """
    with scratch() as keep:
        return keep(stored(_near_duplicates(docs, width, radius, similar), "near"))


def _near_duplicates(docs: DataFrame, width: int, radius: int, similar: float | None) -> DataFrame:
    kept = stored(fingerprints(docs, ["doc_id"], width, similar is not None), "fingerprints")
    ids = stored(kept.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    named = components(ball_links(ids, radius))
    member = ids.join(named, ids["fp"] == named["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    member = stored(member, "members")
    if similar is not None:
        with shuffles_removed(docs.sparkSession), scratch() as keep:
            links = keep(stored(similar_links(kept, docs, width, similar), "similar"))
        of = stored(kept.select("doc_id", "fp").join(member, "fp").select("doc_id", "component"), "groups")
        for end in ("a", "b"):
            links = links.join(of.select(F.col("doc_id").alias(end), F.col("component").alias(f"_{end}")), end)
        upper = components(links.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))
        upper = upper.withColumnRenamed("component", "_top")
        member = member.join(upper, member["component"] == upper["node"], "left").select("fp", "low", F.coalesce("_top", "component").alias("component"))
        member = stored(member, "members")
    lowest = member.groupBy("component").agg(F.min("low").alias("component_id"))
    of = member.join(lowest, "component").select(F.col("fp").alias("_fp"), "component_id")
    return kept.join(of, kept["fp"] == of["_fp"]).select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; shingles of 4 words, links at 4 bits."""
    return near_duplicates(docs, width=4, radius=4).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 5, radius: int = 4, similar: float = SIMILAR) -> DataFrame:
    """The documents with one of each group of near-duplicates: the one of least doc_id, null last."""
    rows = with_row_index(set_aside(docs, "doc_id", "text"), "_row")
    marked = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), width, radius, similar)
    named = rows.select("_row", F.col("doc_id").alias("_id")).join(marked.select(F.col("doc_id").alias("_row"), "component_id"), "_row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_kept")).select(F.col("_kept._row").alias("_row"))
    return rows.join(first, "_row", "left_semi").drop("_row").toDF(*docs.columns)
