"""Whole images: compress, decompress and compare folders of PNG files.

python -m blockloom.images [-cde135uriwh] [--] SOURCE TARGET

-c compress PNG files to block files (default), -d decompress block files to PNG files, -e compare PNG files;
-1, -3, -5 BC1 (default), BC2, BC3; -u weigh colours alike instead of as the eye does; -r range fit, -i iterative cluster
fit (default: cluster fit); -w weigh texels by their alpha.
"""

from __future__ import annotations

import sys
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions.channels import number
from blockloom.operators import cluster, decode, encode, errors, layout
from blockloom.sources.block_files import as_block_files, as_png_files, read_blocks, read_png, write_files


#: What option letters stand for.
OPTIONS = {
    "h": ("help", "yes"), "c": ("mode", "compress"), "d": ("mode", "decompress"), "e": ("mode", "compare"), "1": ("codec", "bc1"), "3": ("codec", "bc2"), "5": ("codec", "bc3"),
    "u": ("metric", "uniform"), "r": ("fit", "range"), "i": ("fit", "iterative"), "w": ("weights", "alpha"), "-": ("options", "end"),
}
DEFAULTS = {"mode": "compress", "codec": "bc1", "metric": "perceptual", "fit": "cluster"}
DECODERS = {"bc1": lambda blocks: decode.bc1(blocks, True), "bc2": decode.bc2, "bc3": decode.bc3}


def parsed(words: list[str]) -> tuple[dict[str, str], list[str]]:
    """Settings and names from a command line; of letters that say otherwise the last counts, and after -- all are names."""
    found, names, open_ = dict(DEFAULTS), [], True
    for word in words:
        if not (open_ and word.startswith("-")):
            names.append(word)
            continue
        for letter in word[1:]:
            if letter not in OPTIONS:
                raise ValueError(f"unknown option {letter!r}")
            setting, value = OPTIONS[letter]
            found[setting] = value
            open_ = open_ and setting != "options"
    if found["fit"] == "range" and "weights" in found:
        raise ValueError("the range fit takes the box of all texels, whatever their weights")
    return found, names


def same_size(w: Column, h: Column, other_w: Column, other_h: Column) -> Column:
    """Only images of the same sides can be compared."""
    return (w == other_w) & (h == other_h)


def rgba(pixels: DataFrame) -> DataFrame:
    """Pixels of 1 to 4 channels in an array as r, g, b, a."""
    at = [F.coalesce(F.get("v", F.lit(k)), number(0)) for k in range(4)]
    return layout.normalised(pixels, F.col("channels"), at)


def compress(pixels: DataFrame, codec: str = "bc1", metric: str = "uniform", fit: str = "range", weighted: bool = False) -> DataFrame:
    """(path, width, height, block, c): the blocks of images (path, width, height, channels, x, y, v).

    fit is range, cluster or iterative; the last two can weigh texels by their alpha.
    """
    colours = encode.range_fit if fit == "range" else partial(cluster.cluster_fit, three=codec == "bc1", weighted=weighted, iterate=fit == "iterative")
    keys = ["path", "width", "height"]
    texels = rgba(pixels).select(*keys, "x", "y", F.array(*"rgba").alias("v"))
    tiles = layout.tiled(texels, keys, "v").select(*keys, (F.col("block_y") * F.floor(F.col("width") / 4) + F.col("block_x")).alias("block"), F.flatten("texels").alias("e"))
    return encode.compressed(tiles, [*keys, "block"], codec, metric, colours)


def decompress(blocks: DataFrame, codec: str = "bc1") -> DataFrame:
    """(path, x, y, v): RGBA pixels of blocks (path, width, height, block, c)."""
    place = blocks.select(F.struct("path", "width").alias("vec_id"), "block", "c")
    found = DECODERS[codec](place)
    across = F.floor(F.col("vec_id.width") / 4)
    x, y = F.pmod("block", across) * 4 + F.pmod("texel", F.lit(4)), F.floor(F.col("block") / across) * 4 + F.floor(F.col("texel") / 4)
    return found.select("vec_id.path", x.alias("x"), y.alias("y"), F.array(*"rgba").alias("v"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, pixels, rms) of images of the same name; channels meet by position, as many as both have."""
    named = lambda df: df.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("name"), "x", "y", "channels", *[F.coalesce(F.get("v", F.lit(k)), number(0)).alias(c) for k, c in enumerate("rgba")])
    a, b = named(a), named(b)
    both = a.join(b.select("name", "x", "y", F.col("channels").alias("others"), *[F.col(c).alias(f"other_{c}") for c in "rgba"]), ["name", "x", "y"], "full")
    met = F.when(F.col("channels").isNull() | F.col("others").isNull(), F.raise_error(F.lit("images of different sizes")).cast("long")).otherwise(F.least("channels", "others"))
    each = sum(F.when(met > k, errors.squared((F.col(c), F.col(f"other_{c}")))).otherwise(0) for k, c in enumerate("rgba"))
    return both.groupBy("name").agg(F.count("*").alias("pixels"), F.sqrt(F.sum(each) / F.count("*")).alias("rms"))


def main(*words: str) -> None:
    found, names = parsed(list(words))
    if "help" in found or len(names) != 2:
        sys.exit(__doc__)
    spark, (source, target), codec = SparkSession.builder.getOrCreate(), names, found["codec"]
    name = F.concat(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1), F.lit(".blk" if found["mode"] == "compress" else ".png")).alias("name")
    if found["mode"] == "compress":
        write_files(as_block_files(compress(read_png(spark, source), codec, found["metric"], found["fit"], "weights" in found).select(name, "width", "height", "block", "c")), target)
    elif found["mode"] == "decompress":
        write_files(as_png_files(decompress(read_blocks(spark, source, encode.CODECS[codec]), codec).select(name, "x", "y", "v")), target)
    else:
        compare(read_png(spark, source), read_png(spark, target)).show(1000, False)


if __name__ == "__main__":
    main(*sys.argv[1:])
