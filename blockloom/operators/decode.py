"""Block decoders as column expressions: a compressed block is an array of byte values, a decoded one a row per texel."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from blockloom.functions.channels import bits, number, replicate


def byte(k: int | Column) -> Column:
    return F.element_at("c", k + 1 if isinstance(k, int) else (k + 1).cast("int"))


def little(first: int, count: int) -> Column:
    """So many bytes, the lowest first, as one number; at most 7, so that the sign stays free."""
    return sum((F.shiftleft(byte(first + k), 8 * k) for k in range(1, count)), byte(first))


def big(first: int, count: int) -> Column:
    return sum((F.shiftleft(byte(first + k), 8 * (count - 1 - k)) for k in range(count - 1)), byte(first + count - 1))


def span(low: int, count: int) -> Column:
    """Bits of a little-endian block, of up to 48, wherever they lie."""
    first, last = low // 8, (low + count - 1) // 8
    return bits(little(first, last - first + 1), low % 8, count)


def by_texel(blocks: DataFrame, n: int = 16) -> DataFrame:
    return blocks.withColumn("texel", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def right(x: Column, places: Column) -> Column:
    """A number without so many of its lowest bits."""
    return F.call_function("shiftright", x, places.cast("int"))


def low_bits(x: Column, n: int) -> Column:
    return x.bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def two_bits(first: int) -> Column:
    """The two-bit code of the texel, codes starting at this byte."""
    t = F.col("texel")
    return low_bits(right(byte(first + F.shiftright(t, 2)), 2 * low_bits(t, 2)), 2)


def rgb565(c: Column) -> list[Column]:
    return [replicate(bits(c, 11, 5), 5), replicate(bits(c, 5, 6), 6), replicate(bits(c, 0, 5), 5)]


def pick(code: Column, options: list[Column]) -> Column:
    out = F.when(code == 0, options[0])
    for k, x in enumerate(options[1:], 1):
        out = out.when(code == k, x)
    return out


def with_palette(blocks: DataFrame, first: int, always_four: bool) -> DataFrame:
    """Adds p_r, p_g, p_b, the four values that codes pick from, and whether the block has four colours.

    They are worked out once for a block, before its texels; interpolants are rounded down.
    """
    c0, c1 = little(first, 2), little(first + 2, 2)
    own = blocks.withColumns({"_c0": c0, "_c1": c1})
    four = F.lit(True) if always_four else F.col("_c0") > F.col("_c1")
    out = {"four": four}
    for n, a, b in zip("rgb", rgb565(F.col("_c0")), rgb565(F.col("_c1"))):
        third, fourth = F.when(four, F.floor((2 * a + b) / 3)).otherwise(F.floor((a + b) / 2)), F.when(four, F.floor((a + 2 * b) / 3)).otherwise(number(0))
        out[f"p_{n}"] = F.array(a, b, third, fourth)
    return own.withColumns(out)


def picked(palette: str, code: Column) -> Column:
    return F.element_at(palette, (code + 1).cast("int"))


def texel_colours(own: DataFrame, first: int, alpha: Column) -> DataFrame:
    code = F.col("code")
    each = by_texel(own).withColumn("code", two_bits(first + 4))
    return each.select("vec_id", "block", "texel", *[picked(f"p_{n}", code).alias(n) for n in "rgb"], alpha.alias("a"))


def bc1(blocks: DataFrame, alpha: bool) -> DataFrame:
    """Eight bytes; with alpha, code 3 of a three-colour block is transparent."""
    a = F.when(~F.col("four") & (F.col("code") == 3), number(0)).otherwise(number(255)) if alpha else number(255)
    return texel_colours(with_palette(blocks, 0, False), 0, a)


def bc2(blocks: DataFrame, honour_order: bool = False) -> DataFrame:
    """Sixteen bytes: four bits of alpha for each texel, then colours, always four of them unless the order is honoured."""
    t = F.col("texel")
    return texel_colours(with_palette(blocks, 8, not honour_order), 8, low_bits(right(byte(F.shiftright(t, 1)), 4 * low_bits(t, 1)), 4) * 17)


def bc3(blocks: DataFrame) -> DataFrame:
    """Sixteen bytes: two alphas with three-bit codes, seven levels or five and the extremes, then colours."""
    a0, a1, t = byte(0), byte(1), F.col("texel")
    seven = F.array(a0, a1, *[F.floor(((7 - k) * a0 + k * a1) / 7) for k in range(1, 7)])
    five = F.array(a0, a1, *[F.floor(((5 - k) * a0 + k * a1) / 5) for k in range(1, 5)], number(0), number(255))
    own = with_palette(blocks, 8, True).withColumns({"p_a": F.when(a0 > a1, seven).otherwise(five), "low": little(2, 3), "high": little(5, 3)})
    code = low_bits(right(F.when(t < 8, F.col("low")).otherwise(F.col("high")), 3 * low_bits(t, 3)), 3)
    return texel_colours(own, 8, picked("p_a", code))


#: Intensity modifiers (small, large) by table codeword: fixed values.
MODIFIERS = ((2, 8), (5, 17), (9, 29), (13, 42), (18, 60), (24, 80), (33, 106), (47, 183))


def etc1(blocks: DataFrame) -> DataFrame:
    """Eight bytes, the highest first; texels go down columns. Texel is row by row in the result, as everywhere.

    What the codes of each half pick from is worked out once for a block, before its texels.
    """
    wide = bits(byte(3), 1, 1) == 1
    own = blocks.select("vec_id", "block", (bits(byte(3), 0, 1) == 1).alias("flip"), big(4, 2).alias("msb"), big(6, 2).alias("lsb"), *[x.alias(n) for n, x in (("t0", bits(byte(3), 5, 3)), ("t1", bits(byte(3), 2, 3)))], *_bases(wide))
    small, large = (F.array(*[number(m[k]) for m in MODIFIERS]) for k in (0, 1))
    own = own.withColumns({f"{n}{h}": F.element_at(table, (F.col(f"t{h}") + 1).cast("int")) for h in (0, 1) for n, table in (("small", small), ("large", large))})
    clip = lambda x: F.least(number(255), F.greatest(number(0), x))
    own = own.withColumns({f"p_{c}{h}": F.array(*[clip(F.col(f"{c}{h}") + sign * F.col(f"{n}{h}")) for sign in (1, -1) for n in ("small", "large")]) for c in "rgb" for h in (0, 1)})
    each = by_texel(own)
    x, y = low_bits(F.col("texel"), 2), F.shiftright("texel", 2)
    place = x * 4 + y  # down columns
    code = low_bits(right(F.col("msb"), place), 1) * 2 + low_bits(right(F.col("lsb"), place), 1)
    each = each.withColumns({"second": F.when(F.col("flip"), y >= 2).otherwise(x >= 2), "code": code})
    return each.select("vec_id", "block", "texel", *[F.when(F.col("second"), picked(f"p_{c}1", F.col("code"))).otherwise(picked(f"p_{c}0", F.col("code"))).alias(c) for c in "rgb"], number(255).alias("a"))


def _bases(wide: Column) -> list[Column]:
    """The base colour of both halves, by channel: five bits and a difference, or four bits each."""
    out = []
    for k, n in enumerate("rgb"):
        five, delta = bits(byte(k), 3, 5), bits(byte(k), 0, 3)
        moved = F.pmod(five + F.when(delta > 3, delta - 8).otherwise(delta), F.lit(32))
        out.append(F.when(wide, replicate(five, 5)).otherwise(bits(byte(k), 4, 4) * 17).alias(f"{n}0"))
        out.append(F.when(wide, replicate(moved, 5)).otherwise(bits(byte(k), 0, 4) * 17).alias(f"{n}1"))
    return out


#: Lowest bits of the five-bit fields of a 16-byte block that modes of FXT1 read.
FIVES = (*range(64, 121, 5), *range(96, 122, 5), *range(94, 120, 5))


def fxt1(blocks: DataFrame) -> DataFrame:
    """Sixteen bytes for 8 by 4 texels, two halves of 16; the mode in the top bits says which of four ways.

    kind: hi, chroma, mixed or alpha; modes without a meaning are read as hi. The fields of a block are read once. Each
    half is a row, whose palette is worked out before its texels pick from it.
    """
    top = span(125, 3)
    kind = F.when(bits(top, 2, 1) == 1, "mixed").when(top == 2, "chroma").when(top == 3, "alpha").otherwise("hi")
    at = sorted(set(FIVES))
    whole = lambda p: F.element_at("c", (F.floor(p / 8) + 1).cast("int")) + 256 * F.coalesce(F.get("c", (F.floor(p / 8) + 1).cast("int")), number(0))
    fields = F.transform(F.array(*[F.lit(p) for p in at]), lambda p: F.pmod(F.floor(whole(p) / F.pow(F.lit(2.0), F.pmod(p, F.lit(8)))), F.lit(32)))
    flags = {"clear": span(124, 1), "low_0": span(125, 1), "low_1": span(126, 1), "select_0": span(1, 1), "select_1": span(33, 1)}
    each = blocks.select("vec_id", "block", "c", kind.alias("kind"), fields.alias("f"), *[x.alias(n) for n, x in flags.items()])
    each = each.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    own = lambda low: F.element_at("f", at.index(low) + 1)
    raw = lambda low: [own(low + 10), own(low + 5), own(low)]
    second, zero, full, clear = F.col("half") == 1, number(0), number(255), F.col("clear") == 1
    either = lambda a, b: F.when(second, b).otherwise(a)
    # by mode: red, green, blue (and alpha) of each colour as five bits, green of a mixed half as six
    mixed = [[either(x, y) for x, y in zip(raw(64 + k), raw(94 + k))] for k in (0, 15)]
    low, select = either(F.col("low_0"), F.col("low_1")), either(F.col("select_0"), F.col("select_1"))
    greens = [F.when(clear, replicate(mixed[0][1], 5)).otherwise(replicate(mixed[0][1] * 2 + F.pmod(select + low, F.lit(2)), 6)), replicate(mixed[1][1] * 2 + low, 6)]
    three = [[*raw(64 + 15 * k), own(109 + 5 * k)] for k in range(3)]
    outer = [either(x, y) for x, y in zip(three[0], three[2])]
    colours = {"hi": [raw(96), raw(111)], "chroma": [raw(64 + 15 * k) for k in range(4)], "mixed": mixed, "alpha": [*three, outer]}
    eight = lambda some, n: F.array(*[replicate(c[n], 5) for c in some])
    picked = [F.when(F.col("kind") == "hi", eight(colours["hi"], n)).when(F.col("kind") == "chroma", eight(colours["chroma"], n)).when(F.col("kind") == "mixed", F.array(*greens) if n == 1 else eight(mixed, n)).otherwise(eight(colours["alpha"], n)) for n in range(3)]
    alphas = F.when(F.col("kind") == "alpha", eight(colours["alpha"], 3)).otherwise(F.array(full, full, full, full))
    each = each.select("vec_id", "block", "kind", "c", "half", "clear", *[x.alias(f"p_{n}") for n, x in zip("rgba", [*picked, alphas])])

    def levels(n: str, first: int, last: int, parts: int, half: int) -> list[Column]:
        x, y = (F.element_at(f"p_{n}", k + 1) for k in (first, last))
        return [x, *[F.floor(((parts - k) * x + k * y + half) / parts) for k in range(1, parts)], y]

    def palette(n: str) -> Column:
        hi = F.array(*([full] * 7 if n == "a" else levels(n, 0, 1, 6, 3)), zero)
        half = F.array(full, full, full, zero) if n == "a" else F.array(*levels(n, 0, 1, 2, 0), zero)
        mixed = F.when(clear, half).otherwise(F.array(*[full] * 4) if n == "a" else F.array(*levels(n, 0, 1, 3, 1)))
        alpha = F.when(clear, F.array(*levels(n, 3, 1, 3, 1))).otherwise(F.array(*[F.element_at(f"p_{n}", k) for k in (1, 2, 3)], zero))
        return F.when(F.col("kind") == "hi", hi).when(F.col("kind") == "chroma", F.col(f"p_{n}")).when(F.col("kind") == "mixed", mixed).otherwise(alpha)

    each = each.select("vec_id", "block", "kind", "c", "half", *[palette(n).alias(n) for n in "rgba"])
    each = by_texel(each, 16).withColumn("texel", F.col("texel") + 16 * F.col("half"))
    t = F.col("texel")
    code3 = low_bits(right(pick(F.shiftright(t, 3), [little(3 * k, 3) for k in range(4)]), 3 * low_bits(t, 3)), 3)
    each = each.select("vec_id", "block", "kind", "texel", (F.when(F.col("kind") == "hi", code3).otherwise(two_bits(0)) + 1).cast("int").alias("place"), *"rgba")
    return each.select("vec_id", "block", "kind", "texel", *[F.element_at(n, F.col("place")).alias(n) for n in "rgba"])


#: Palette entries by format: bytes of an entry.
PALETTE_FORMATS = {"rgb8": 3, "rgba8": 4, "r5_g6_b5": 2, "rgba4": 2, "rgb5_a1": 2}
#: Of entries of two bytes, the lowest first, where each channel begins and how many bits it has.
PACKED = {"r5_g6_b5": ((11, 5), (5, 6), (0, 5)), "rgba4": ((12, 4), (8, 4), (4, 4), (0, 4)), "rgb5_a1": ((11, 5), (6, 5), (1, 5), (0, 1))}


def palette_entries(form: str, raw: np.ndarray) -> np.ndarray:
    """r, g, b, a of palette entries, of which raw has the bytes in a row each."""
    out = np.full((len(raw), 4), 255, np.uint8)
    if form not in PACKED:
        out[:, : raw.shape[1]] = raw
        return out
    w = raw[:, 0].astype(np.uint16) | raw[:, 1].astype(np.uint16) << 8
    for k, (at, n) in enumerate(PACKED[form]):
        v = w >> at & (1 << n) - 1
        out[:, k] = v * 255 if n == 1 else v << 8 - n | v >> 2 * n - 8
    return out


def paletted_levels(data: bytes, form: str, wide: bool, width: int, height: int, levels: int) -> list[np.ndarray]:
    """The mip levels of a paletted image as arrays of its rows, texels and channels; none if it has too few bytes."""
    raw, size, n = np.frombuffer(data, np.uint8), PALETTE_FORMATS[form], 256 if wide else 16
    sides = [(max(width >> k, 1), max(height >> k, 1)) for k in range(levels)]
    held = [w * h if wide else (w * h + 1) // 2 for w, h in sides]
    if len(raw) < n * size + sum(held):
        return []
    entries, at, out = palette_entries(form, raw[: n * size].reshape(n, size)), n * size, []
    for (w, h), m in zip(sides, held):
        codes = raw[at : at + m]
        if not wide:
            codes = np.stack([codes >> 4, codes & 15], axis=1).ravel()[: w * h]
        out.append(entries[codes].reshape(h, w, 4))
        at += m
    return out


def by_level(images: DataFrame, keys: list[str], levels: int, columns: str, rows_of: Callable[[np.ndarray, int], tuple]) -> DataFrame:
    """(keys, level, columns) of paletted images: a row for each level, with what rows_of says of its texels and the image's width."""
    shape = StructType([images.schema[k] for k in keys]).add("level", "long")
    for c in columns.split(", "):
        shape.add(*c.split(" "))
    types = to_arrow_schema(shape).types

    def run(batches):
        def found():
            for b in batches:
                for *own, form, wide, width, height, data in zip(*(c.to_pylist() for c in b.columns)):
                    if form in PALETTE_FORMATS and None not in (wide, width, height, data):
                        for k, texels in enumerate(paletted_levels(data, form, wide, width, height, levels)):
                            yield *own, k, *rows_of(texels, width)

        rows = found()
        while some := list(itertools.islice(rows, 256)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=shape.names)

    return images.select(*keys, "form", "wide", F.col("width").cast("long"), F.col("height").cast("long"), F.col("bytes").cast("binary")).mapInArrow(run, shape)


def paletted(images: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """(keys, level, width, height, data) of images (keys, form, wide, width, height, bytes); data has r, g, b, a of each texel, row by row.

    The bytes are a palette of entries of the form, 256 of them if wide and 16 else, then so many mip levels of codes:
    bytes if wide, halves of bytes else, the high half first; a level ends with a whole byte. Sides halve from level to
    level, to 1 at least. Rows with too few bytes are left out. An image is decoded within its row: its palette once,
    then its texels by their codes.
    """
    return by_level(images, keys, levels, "width long, height long, data binary", lambda texels, _: (texels.shape[1], texels.shape[0], texels.tobytes()))


def paletted_sums(images: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """(keys, level, texels, sum_r, sum_g, sum_b, sum_a) of the same images: each channel times y * width + x + 1, of all texels of a level."""

    def sums(texels: np.ndarray, width: int) -> tuple:
        h, w, _ = texels.shape
        place = np.add.outer(np.arange(h) * width, np.arange(1, w + 1)).ravel()
        return h * w, *(place @ texels.reshape(-1, 4).astype(np.int64)).tolist()

    return by_level(images, keys, levels, "texels long, sum_r long, sum_g long, sum_b long, sum_a long", sums)


def volume(blocks: DataFrame, w: int, h: int, d: int) -> DataFrame:
    """(vec_id, x, y, z, r, g, b, a) of volumes of BC1 layers: blocks (vec_id, block, c), numbered by their offset over 8."""
    from blockloom.operators.layout import volume_block
    from blockloom.sources.generators import grid

    each = grid(blocks.sparkSession, x=range(w), y=range(h), z=range(d))
    layer = F.when(F.col("z") < 4 * (d // 4), F.pmod("z", F.lit(4))).otherwise(0)
    first = volume_block(number(w), number(h), number(d), F.col("x"), F.col("y"), F.col("z"), 8)
    place = each.select("x", "y", "z", (F.floor(first / 8) + layer).alias("block"), (4 * F.pmod("y", F.lit(4)) + F.pmod("x", F.lit(4))).alias("texel"))
    return bc1(blocks, False).join(F.broadcast(place), ["block", "texel"]).select("vec_id", "x", "y", "z", *"rgba")
