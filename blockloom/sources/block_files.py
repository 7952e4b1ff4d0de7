"""Files of compressed blocks (width, height as little-endian integers, then the blocks) and PNG images."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Passes of an interlaced image: first column and row, steps right and down (fixed values).
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def byte_at(content: Column, place: Column | int) -> Column:
    """The byte at this place, from 1, as a number."""
    place = F.lit(place) if isinstance(place, int) else place.cast("int")
    return F.conv(F.hex(F.substring(content, place, F.lit(1))), 16, 10).cast("long")


def little_int(content: Column, place: int) -> Column:
    return sum((F.shiftleft(byte_at(content, place + k), 8 * k) for k in range(1, 4)), byte_at(content, place))


def read_blocks(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(path, width, height, block, c): the blocks of every file below the path, of so many bytes each.

    Raises where width or height is no multiple of 4, or where the file's length is another than they say.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content", little_int(F.col("content"), 1).alias("width"), little_int(F.col("content"), 5).alias("height"))
    count = F.floor(F.col("width") * F.col("height") / 16)
    fine = (F.pmod("width", F.lit(4)) == 0) & (F.pmod("height", F.lit(4)) == 0) & (F.col("length") == 8 + count * size)
    files = files.withColumn("n", F.when(fine, count).otherwise(F.raise_error(F.concat(F.lit("not a file of whole blocks: "), "path")).cast("long")))
    each = files.where("n > 0").select("path", "width", "height", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
    own = F.substring("content", (F.col("block") * size + 9).cast("int"), F.lit(size))
    each = each.select("path", "width", "height", "block", own.alias("own"))
    return each.select("path", "width", "height", "block", F.array(*[byte_at(F.col("own"), k + 1) for k in range(size)]).alias("c"))


def as_bytes(numbers: Column) -> Column:
    return F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def as_block_files(blocks: DataFrame, name: str = "name") -> DataFrame:
    """(name, content) from (name, width, height, block, c): one row per image, as large as the image's file."""
    whole = blocks.groupBy(name, "width", "height").agg(F.array_sort(F.collect_list(F.struct("block", "c"))).alias("b"))
    head = F.flatten(F.array(*[F.array(*[F.pmod(F.shiftright(x.cast("long"), 8 * k), F.lit(256)) for k in range(4)]) for x in (F.col("width"), F.col("height"))]))
    return whole.select(name, as_bytes(F.concat(head, F.flatten(F.transform("b", lambda x: x["c"])))).alias("content"))


def unfiltered(data: bytes, height: int, stride: int, bpp: int) -> np.ndarray:
    """PNG rows with their filters undone, neighbouring rows of one filter at a time where it allows that."""
    rows = np.frombuffer(data, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + bpp), np.uint8)
    kinds = rows[:, 0]
    edge = [0, *((kinds[1:] != kinds[:-1]).nonzero()[0] + 1).tolist(), height]
    for s, e in zip(edge, edge[1:]):
        kind, own, now = int(rows[s, 0]), rows[s:e, 1:], out[s + 1 : e + 1, bpp:]
        if kind == 0:
            now[:] = own
        elif kind == 1:
            now[:] = np.cumsum(own.reshape(e - s, -1, bpp), axis=1, dtype=np.uint8).reshape(own.shape)
        elif kind == 2:
            now[:] = np.cumsum(own, axis=0, dtype=np.uint8) + out[s, bpp:]
        else:
            for y in range(s, e):
                undone(kind, rows[y, 1:].tolist(), out[y], out[y + 1], bpp)
    return out[1:, bpp:]


def undone(kind: int, own: list[int], up: np.ndarray, now: np.ndarray, bpp: int) -> None:
    """Undoes filter 3 or 4 of a row; up and now begin bpp places before it."""
    above, found = up.tolist(), [0] * bpp
    for x, v in enumerate(own, bpp):
        a, b, c = found[x - bpp], above[x], above[x - bpp]
        p = a + b - c
        near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        found.append((v + {3: (a + b) // 2, 4: near}[kind]) & 255)
    now[:] = found


def png_pixels(content: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, pixels of 1 to 4 channels of 8 bits).

    Palettes are looked up, grey of 1, 2 or 4 bits is spread to 8, and a transparent colour or palette entry becomes alpha.
    """
    if content[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, parts, found = 8, [], {}
    while at < len(content):
        (n,), kind = struct.unpack(">I", content[at : at + 4]), content[at + 4 : at + 8]
        found[kind] = content[at + 8 : at + 8 + n]
        if kind == b"IDAT":
            parts.append(found[kind])
        at += 12 + n
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", found[b"IHDR"])
    if depth == 16:
        raise ValueError("only 8 bits a channel or less")
    channels, clear = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour], found.get(b"tRNS")
    data, at = zlib.decompress(b"".join(parts)), 0
    pixels = np.zeros((height, width, channels), np.uint8)
    for x, y, right, down in PASSES if interlaced else ((0, 0, 1, 1),):
        own = pixels[y::down, x::right]
        if not own.size:  # a pass of no pixels has no rows, not even their filters
            continue
        stride = (own.shape[1] * channels * depth + 7) // 8
        rows = unfiltered(data[at : at + len(own) * (stride + 1)], len(own), stride, max(1, channels * depth // 8))
        at += len(own) * (stride + 1)
        if depth < 8:
            bits_ = np.unpackbits(rows, axis=1).reshape(len(own), -1, depth)[:, : own.shape[1]]
            rows = (bits_ @ (1 << np.arange(depth)[::-1])).astype(np.uint8)
        own[:] = rows.reshape(own.shape)
    if colour == 3:
        palette = np.frombuffer(found[b"PLTE"], np.uint8).reshape(-1, 3)
        if clear is not None:
            alpha = np.full(len(palette), 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
            palette = np.column_stack([palette, alpha])
        return width, height, palette[pixels[:, :, 0]]
    alpha = None
    if clear is not None:  # one colour, in 16 bits a channel
        alpha = np.where((pixels == np.frombuffer(clear, ">u2")).all(2), 0, 255).astype(np.uint8)
    if depth < 8:
        pixels = (pixels.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return width, height, pixels if alpha is None else np.dstack([pixels, alpha])


def png_bytes(pixels: np.ndarray, interlaced: bool = False, filter_: int = 0) -> bytes:
    """An image of 8 bits a channel; rows are filtered by none (0) or by the pixel above (2)."""
    height, width, channels = pixels.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, int(interlaced))
    rows = []
    for x, y, right, down in PASSES if interlaced else ((0, 0, 1, 1),):
        own = pixels[y::down, x::right]
        if own.size:
            flat = own.reshape(len(own), -1)
            filtered = np.empty((len(own), flat.shape[1] + 1), np.uint8)
            filtered[:, 0], filtered[:, 1:] = filter_, flat
            if filter_ == 2:
                filtered[1:, 1:] -= flat[:-1]
            rows.append(filtered.tobytes())
    return SIGNATURE + part(b"IHDR", head) + part(b"IDAT", zlib.compress(b"".join(rows))) + part(b"IEND", b"")


def png_header(content: Column) -> dict[str, Column]:
    """Whether a file begins as PNG files do, and its sides, bits a channel and kind of colour; null if it does not."""
    fine = F.substring(content, 1, 8) == F.lit(SIGNATURE)
    big = lambda place: sum((F.shiftleft(byte_at(content, place + k), 24 - 8 * k) for k in range(1, 4)), F.shiftleft(byte_at(content, place), 24))
    fields = {"width": big(17), "height": big(21), "depth": byte_at(content, 25), "colour": byte_at(content, 26)}
    return {"is_png": fine, **{n: F.when(fine, x) for n, x in fields.items()}}


#: Bytes of images of a record batch, and folders that many files are dealt to.
IMAGES, FOLDERS = 4 << 20, 256


def in_batches(rows: Iterable[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of some IMAGES bytes; the last value of each is what is large."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= IMAGES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def rasters_as_png(images: DataFrame, interlaced: bool = False) -> DataFrame:
    """(name, content) from (name, width, channels, data): PNG files of images in one row each, data their bytes row by row."""

    def run(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        made = ((name, png_bytes(np.frombuffer(data, np.uint8).reshape(-1, width, channels), interlaced, 2 * interlaced)) for name, width, channels, data in rows)
        yield from in_batches(made, ["name", "content"], [pa.string(), pa.binary()])

    return images.select("name", F.col("width").cast("int"), F.col("channels").cast("int"), "data").mapInArrow(run, "name string, content binary")


def in_folder(name: Column) -> Column:
    """The name within one of FOLDERS folders, so that no folder holds too many files and tasks can read a folder each."""
    return F.concat(F.pmod(F.xxhash64(name), F.lit(FOLDERS)).cast("string"), F.lit("/"), name)


def read_png_folders(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels, data): the images of all PNG files in the folders below the path, data their bytes row by row.

    Each folder is listed and read by a task, so that nothing holds the names of all files. For file systems that pyarrow knows.
    """
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(path)
    folders = sorted(f.path for f in system.get_file_info(fs.FileSelector(base)) if not f.is_file)

    def images(names: Iterable[str]):
        system, _ = fs.FileSystem.from_uri(path)
        for folder in names:
            for f in system.get_file_info(fs.FileSelector(folder)):
                if f.is_file and not f.base_name.startswith((".", "_")):
                    with system.open_input_file(f.path) as file:
                        width, height, p = png_pixels(file.read())
                    yield f.path, width, height, p.shape[2], p.tobytes()

    def run(batches):
        yield from in_batches(images(x for b in batches for x in b.column(0).to_pylist()), ["path", "width", "height", "channels", "data"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])

    tasks = max(1, min(len(folders), 4 * spark.sparkContext.defaultParallelism))
    each = spark.createDataFrame([(x,) for x in folders], "folder string").repartition(tasks)
    return each.mapInArrow(run, "path string, width long, height long, channels long, data binary")


def read_png(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels, x, y, v): the pixels of every PNG file below the path, channels in an array."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                width, height, p = png_pixels(content.as_py())
                n = width * height
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n), *[pa.array(np.full(n, x, np.int64)) for x in (width, height, p.shape[2])], pa.array(np.tile(np.arange(width), height)), pa.array(np.repeat(np.arange(height), width)), pa.array(list(p.reshape(n, -1).astype(np.int64)), pa.list_(pa.int64()))],
                    names=["path", "width", "height", "channels", "x", "y", "v"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, width long, height long, channels long, x long, y long, v array<long>")


def as_png_files(pixels: DataFrame, name: str = "name", interlaced: bool = False) -> DataFrame:
    """(name, content) from (name, x, y, v): one row per image."""

    def run(rows: pa.Table) -> pa.Table:
        x, y = (rows.column(c).to_numpy() for c in "xy")
        v = np.array(rows.column("v").to_pylist(), np.uint8)
        image = np.zeros((y.max() + 1, x.max() + 1, v.shape[1]), np.uint8)
        image[y, x] = v
        return pa.table({name: rows.column(name).slice(0, 1), "content": pa.array([png_bytes(image, interlaced, 2 * interlaced)], pa.binary())})

    return pixels.select(name, "x", "y", "v").groupBy(name).applyInArrow(run, f"{name} {pixels.schema[name].dataType.simpleString()}, content binary")


class Files(DataSource):
    """Writes rows of (name, content) as files of these names below option path, a folder that all executors share.

    Names can have folders in them."""

    @classmethod
    def name(cls) -> str:
        return "content_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(self.options["path"])


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows):
        from pyarrow import fs

        # a scheme that no file system is known for raises here, instead of ending up in a local folder
        system, base = fs.FileSystem.from_uri(self.path)
        system.create_dir(base, recursive=True)
        made = {""}
        for r in rows:
            folder, name = os.path.split(r.name)
            if folder not in made:
                system.create_dir(f"{base}/{folder}", recursive=True)
                made.add(folder)
            own = f"{base}/{folder}/.{name}.{os.getpid()}"
            with system.open_output_stream(own) as f:
                f.write(r.content)
            system.move(own, f"{base}/{r.name}")  # a task that runs again puts the same file in its place
        return WriterCommitMessage()


def write_files(df: DataFrame, path: str) -> None:
    df.sparkSession.dataSource.register(Files)
    df.select(F.col("name").cast("string").alias("name"), "content").write.format("content_files").option("path", path).mode("append").save()


#: Blocks of a task at most, and of a record batch.
RANGE, BATCH = 1 << 18, 1 << 13


class BlockRanges(InputPartition):
    """What one task reads: of some files (path, all blocks), blocks first to last (excluded)."""

    def __init__(self, parts: list[tuple[str, int, int, int]]) -> None:
        self.parts = parts


class BlockFiles(DataSource):
    """Reads block files below option path by ranges of blocks: (path, width, height, block, c). A large file is read by
    several tasks, small ones share a task.

    Options: size, bytes of a block (8 or 16); range, blocks of a task at most. The path is one that pyarrow's file
    systems know. Comparisons of block with numbers are pushed down: tasks read no bytes of other blocks.
    """

    @classmethod
    def name(cls) -> str:
        return "block_files"

    def schema(self) -> str:
        return "path string, width long, height long, block long, c array<long>"

    def reader(self, schema) -> DataSourceReader:
        return BlockFilesReader(self.options["path"], int(self.options["size"]), int(self.options.get("range", RANGE)))


class BlockFilesReader(DataSourceReader):
    def __init__(self, path: str, size: int, range_: int) -> None:
        self.path, self.size, self.range, self.low, self.high = path, size, range_, 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on block; all filters are looked at by Spark as well."""
        for f in filters:
            if getattr(f, "attribute", None) == ("block",):
                if isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThanOrEqual | LessThan):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
                if isinstance(f, In) and f.value:
                    self.low, self.high = max(self.low, min(f.value)), min(self.high, max(f.value) + 1)
            yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(base)
        files = [found] if found.is_file else [f for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
        out, held = [[]], 0
        for f in files:
            count, rest = divmod(f.size - 8, self.size)
            if count < 0 or rest:
                raise ValueError(f"not a file of whole blocks: {f.path}")
            at, last = max(0, self.low), min(count, self.high)
            while at < last:
                if held == self.range:
                    out.append([])
                    held = 0
                n = min(last - at, self.range - held)
                out[-1].append((f.path, count, at, at + n))
                at, held = at + n, held + n
        return [BlockRanges(parts) for parts in out]

    def read(self, task: BlockRanges) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        for path, count, first, last in task.parts:
            with system.open_input_file(path) as file:
                width, height = struct.unpack("<ii", file.read(8))
                if width % 4 or height % 4 or width * height != 16 * count:
                    raise ValueError(f"not a file of whole blocks: {path}")
                file.seek(8 + first * self.size)
                for at in range(first, last, BATCH):
                    n = min(BATCH, last - at)
                    codes = np.frombuffer(file.read(n * self.size), np.uint8).astype(np.int64)
                    whole = lambda x, n=n: pa.array(np.full(n, x, np.int64))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(codes) + 1, self.size), pa.int32()), pa.array(codes))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), whole(width), whole(height), pa.array(np.arange(at, at + n)), lists], names=["path", "width", "height", "block", "c"])


def read_block_ranges(spark: SparkSession, path: str, size: int, range_: int = RANGE) -> DataFrame:
    """The same rows as read_blocks: a file of any size spreads over tasks, and filters on block leave out what they can.

    For file systems that pyarrow knows; read_blocks takes every path that Spark can read.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockFiles)
    return spark.read.format("block_files").option("path", path).option("size", size).option("range", range_).load()
