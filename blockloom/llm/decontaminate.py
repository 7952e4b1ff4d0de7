"""Benchmark decontamination: pigeonhole pieces, exact hits, Myers' bit-parallel distance."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, set_aside, stored, texts, with_row_index

#: Edits allowed as a share of an item's length.
ERRORS = 0.05
#: Logarithm of the bits that say which grams are pieces.
FILTER = 27
#: Items that may share a piece before they are cut elsewhere, and characters that such pieces have at least.
SHARED, LEAST = 8, 6
BASE, SPREAD = 0x5851F42D4C957F2D, np.uint64(0x9E3779B97F4A7C15)
NOISE = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    """Lower case, with every run of anything but letters and digits as one space."""
    return NOISE.sub(" ", text.lower()).strip()


def pieces(item: str, errors: float) -> list[tuple[int, str]]:
    """The item cut into one piece more than the edits it may have: one of them stays whole in any match."""
    n = int(len(item) * errors) + 1
    cut = [len(item) * k // n for k in range(n + 1)]
    return [(s, item[s:e]) for s, e in zip(cut, cut[1:])]


def apart(item: str, errors: float, common: list[bool]) -> list[tuple[int, str]]:
    """As many pieces again, but none from those that are common: of any part of the item, too, one piece stays whole.

    What is left is cut evenly, run by run. An item that has too little left keeps its pieces.
    """
    plain, runs = pieces(item, errors), []
    for (start, piece), skip in zip(plain, common):
        if skip:
            continue
        if runs and runs[-1][1] == start:
            runs[-1][1] = start + len(piece)
        else:
            runs.append([start, start + len(piece)])
    left = sum(e - s for s, e in runs)
    if not any(common) or left < LEAST * len(plain):
        return plain
    count = [(e - s) * len(plain) // left for s, e in runs]
    for k in sorted(range(len(runs)), key=lambda k: -((runs[k][1] - runs[k][0]) * len(plain) % left))[: len(plain) - sum(count)]:
        count[k] += 1
    cuts = [(s + (e - s) * k // n, s + (e - s) * (k + 1) // n) for (s, e), n in zip(runs, count) for k in range(n)]
    return [(s, item[s:e]) for s, e in cuts]


def distance_within(item: str, text: str, most: int) -> int | None:
    """Least edit distance of the whole item to any substring of text, by Myers' bit vectors; None if above most."""
    m = len(item)
    at: dict[str, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = at.get(c, 0)
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        hp, hm = minus | (full & ~(d | plus)), plus & d
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp, hm = (hp << 1) & full, (hm << 1) & full
        plus, minus = hm | (full & ~(d | hp)), hp & d
        if score < best:
            best = score
    return best if best <= most else None


class Grams:
    """The hashes of each n neighbouring characters of a text, by joining up hashes of 1, 2, 4, … of them."""

    def __init__(self, codes: np.ndarray) -> None:
        self.doubled = [codes]

    def of(self, n: int) -> np.ndarray:
        out, done = None, 0
        for k in range(n.bit_length()):
            width = 1 << k
            if k == len(self.doubled):
                h, half = self.doubled[-1], width // 2
                self.doubled.append(h[:-half] * np.uint64(pow(BASE, half, 1 << 64)) + h[half:])
            h = self.doubled[k]
            if n & width:
                out = h if out is None else out[: len(h) - done] * np.uint64(pow(BASE, width, 1 << 64)) + h[done:] if len(h) > done else h[:0]
                done += width
        out = (out ^ (out >> np.uint64(31))) * SPREAD + np.uint64(n * BASE % (1 << 64))
        return out ^ (out >> np.uint64(29))


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def normalised(batches):
    """(item_id, item) from (item_id, text)."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.columns[0], pa.array([normal(t) for t in texts(b.column(1))], pa.string())], names=["item_id", "item"])


def cut_up(items: DataFrame, errors: float, common: bool = False) -> DataFrame:
    """(_item, k, start, width, gram): where in its item each piece starts, and the hash of the whole piece.

    Where the items have an array `common`, those pieces are kept out if the rest can be cut as often.
    """

    def run(batches):
        for b in batches:
            out = [[], [], [], [], []]
            shared = b.column(2).to_pylist() if common else [()] * b.num_rows
            for key, item, skip in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shared):
                codes = characters(item)
                for k, (start, piece) in enumerate(apart(item, errors, skip) if skip else pieces(item, errors)):
                    for x, v in zip(out, (key, k, start, len(piece), int(Grams(codes[start : start + len(piece)]).of(len(piece)).view(np.int64)[0]))):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["_item", "k", "start", "width", "gram"])

    return items.select("_item", "item", *(["common"] if common else [])).mapInArrow(run, "_item long, k long, start long, width long, gram long")


def known_pieces(items: DataFrame, errors: float) -> DataFrame:
    """(_item, start, width, gram): the pieces by which items are looked up.

    Many items of a question set begin alike, so a text that holds their opening would be held against all of them.
    Items with pieces that more than SHARED items have are cut up anew beside these.
    """
    found = stored(cut_up(items, errors), "cut")
    often = found.groupBy("width", "gram").agg(F.count_distinct("_item").alias("n")).where(F.col("n") > SHARED).select("width", "gram")
    often = stored(often, "often").withColumn("often", F.lit(True))
    flags = found.join(often, ["width", "gram"], "left").groupBy("_item").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("often", F.lit(False)).alias("often")))).alias("x"))
    flags = flags.select("_item", F.transform("x", lambda x: x["often"]).alias("common"))
    return cut_up(items.join(flags, "_item"), errors, True).drop("k")


def found_grams(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(_row, said, place, width, gram) of the texts with grams that may be pieces: the normalised text, and the grams in
    arrays. Only these texts travel.

    A table of 2^FILTER bits says which may; it is of that size whatever the benchmark, and lets some others through. A
    piece is shorter than one part in errors, so there are as few widths.
    """
    bit = F.shiftrightunsigned("gram", 64 - FILTER) + 1  # bitmaps number from 1
    parts = found.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bits = np.zeros((1 << FILTER) // 8, np.uint8)
    for r in parts.collect():
        at = (r.k - 1) * len(r.bits)
        bits[at : at + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)[: len(bits) - at]
    shared = rows.sparkSession.sparkContext.broadcast((bits, sorted(r.width for r in found.select("width").distinct().collect())))
    numbers = pa.list_(pa.int64())

    def run(batches):
        known, widths = shared.value
        for b in batches:
            out = [[], [], [], [], []]
            for key, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                said = normal(text)
                grams, own, n = Grams(characters(said)), [[], [], []], len(said)
                for width in widths:
                    if n >= width:
                        h = grams.of(width)
                        k = (h >> np.uint64(64 - FILTER)).astype(np.int64)
                        place = np.flatnonzero(known[k >> 3] >> (k & 7).astype(np.uint8) & 1)
                        for x, v in zip(own, (place, np.full(len(place), width), h[place].view(np.int64))):
                            x.append(v)
                if any(len(x) for x in own[0]):
                    for x, v in zip(out, (key, said.encode("utf-8", "surrogatepass"), *map(np.concatenate, own))):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), numbers, numbers, numbers))], names=["_row", "said", "place", "width", "gram"])

    return rows.select("_row", F.col("text").cast("binary").alias("_text")).mapInArrow(run, "_row long, said binary, place array<long>, width array<long>, gram array<long>")


def least_edits(item: str, text: str, starts: list[int], errors: float) -> int | None:
    """Edits of an item that begins near one of these places; None if there are too many."""
    if item in text:
        return 0
    most, best, upto = int(len(item) * errors), None, -1
    windows: list[list[int]] = []
    for s in sorted(starts):  # windows that meet are looked at together
        lo, hi = max(0, s - most), s + len(item) + most
        if lo <= upto:
            windows[-1][1] = hi
        else:
            windows.append([lo, hi])
        upto = hi
    for lo, hi in windows if most else ():
        d = distance_within(item, text[lo:hi], most if best is None else best)
        if d is not None:
            best = d
    return best


def verified(candidates: DataFrame, errors: float) -> DataFrame:
    """(_row, _items): matches as (none, item_id, distance) of texts with all their candidates (_row, said, asked), a text once."""
    kind = pa.list_(pa.struct([("none", pa.bool_()), ("item_id", pa.int64()), ("distance", pa.int32())]))

    def run(batches):
        for b in batches:
            out = []
            for said, asked in zip(b.column(1), b.column(2)):
                text, own = said.as_py().decode("utf-8", "surrogatepass"), []
                for x in asked.as_py():
                    # the starts are where a whole piece would have the item begin; the distance settles what hashes suggest
                    if (d := least_edits(x["item"], text, x["starts"], errors)) is not None:
                        own.append({"none": x["item_id"] is None, "item_id": x["item_id"], "distance": d})
                out.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["_row", "_items"])

    return candidates.mapInArrow(run, "_row long, _items array<struct<none:boolean,item_id:bigint,distance:int>>")


def find_items(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """docs with `_items`: an array of (item_id, distance) of the benchmark items that each whole text holds, or null.

    An item matches if some substring of the document's text, both normalised, is within errors times the item's
    length in edits. One of an item's pieces stays whole in a match: texts' grams that a bit table lets through meet the
    whole pieces in a join, and each candidate's window is measured. So neither benchmark nor documents pass through the
    driver.

    Items without letters or digits match nothing; one of fewer than 20 characters allows no edit. Null texts and empty
    ones hold nothing; very long texts are looked at whole. Repeated items count once, repeated documents each for
    itself; items of one document are in order of item_id, null last, then distance. Other columns pass through, but for
    one named `_items`, which is replaced.
    """
    docs = docs.drop("_items")
    rows = with_row_index(set_aside(docs, "text"), "_row")
    with scratch() as keep:
        items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).mapInArrow(normalised, "item_id long, item string").distinct().where("item <> ''")
        items = stored(items.withColumn("_item", F.monotonically_increasing_id()), "items")
        found = stored(known_pieces(items, errors), "pieces")
        hits = stored(found_grams(rows, found), "hits")
        each = hits.select("_row", F.explode(F.arrays_zip("place", "width", "gram")).alias("x")).select("_row", "x.*")
        met = each.join(found, ["width", "gram"]).select("_row", "_item", (F.col("place") - F.col("start")).alias("at"))
        met = met.groupBy("_row", "_item").agg(F.collect_set("at").alias("starts"))
        # a text's candidates are no more than its hits times the items that share a piece, so the array is bounded by the text
        met = stored(met.join(items, "_item").groupBy("_row").agg(F.collect_list(F.struct("item_id", "item", "starts")).alias("asked")), "candidates")
        got = verified(hits.select("_row", "said").join(met.hint("merge"), "_row").select("_row", "said", "asked"), errors).where(F.size("_items") > 0)
        sorted_ = F.transform(F.array_sort("_items"), lambda x: F.struct(x["item_id"].alias("item_id"), x["distance"].alias("distance")))
        got = keep(stored(got.select(F.col("_row").alias("_of"), sorted_.alias("_items")), "got"))
    return rows.join(got.hint("merge"), F.col("_row") == F.col("_of"), "left").drop("_row", "_of").toDF(*docs.columns, "_items")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item.

    Null and empty texts hold none and stay; texts of any length are looked at whole; repeated documents stay or go
    alike. All columns stay as they are, whatever their names; an empty table or benchmark leaves all.
    """
    return find_items(set_aside(docs, "text"), benchmark).where("_items is null").drop("_items").toDF(*docs.columns)


def op7_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, items (ids, ascending), least_distance (null without items)."""
    ids = F.array_distinct(F.transform("_items", lambda x: x["item_id"]))
    kept = find_items(docs.select("doc_id", "text"), benchmark)
    return kept.select("doc_id", F.col("_items").isNotNull().alias("contaminated"), F.when(ids.isNull(), 0).otherwise(F.size(ids)).cast("long").alias("n_items"), F.coalesce(ids, F.array().cast("array<bigint>")).alias("items"), F.array_min(F.transform("_items", lambda x: x["distance"])).alias("least_distance"))
