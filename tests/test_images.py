import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom import images
from blockloom.plans import files
from blockloom.sources import block_files


def test_png_to_blocks_and_back(spark, tmp_path):
    y, x = np.mgrid[0:8, 0:12]
    colour = np.stack([x * 20, y * 30, 255 - x * 20], axis=2).astype(np.uint8)
    grey = np.full((4, 4, 1), 90, np.uint8)
    for d in ("png", "blocks", "back"):
        (tmp_path / d).mkdir()
    (tmp_path / "png/a.png").write_bytes(block_files.png_bytes(colour))
    (tmp_path / "png/b.png").write_bytes(block_files.png_bytes(grey))
    images.main(str(tmp_path / "png"), str(tmp_path / "blocks"))
    assert (tmp_path / "blocks/a.blk").read_bytes()[:8] == (12).to_bytes(4, "little") + (8).to_bytes(4, "little") and (tmp_path / "blocks/a.blk").stat().st_size == 8 + 6 * 8
    images.main("-d", str(tmp_path / "blocks"), str(tmp_path / "back"))
    width, height, p = block_files.png_pixels((tmp_path / "back/a.png").read_bytes())
    assert (width, height) == (12, 8) and abs(p[:, :, :3].astype(int) - colour).max() <= 64
    rms = {r.name: (r.pixels, r.rms) for r in images.compare(block_files.read_png(spark, str(tmp_path / "png")), block_files.read_png(spark, str(tmp_path / "back"))).collect()}
    assert rms["a"][0] == 96 and 0 < rms["a"][1] < 60 and rms["b"][1] <= 12


def test_refusals(spark, tmp_path):
    (tmp_path / "c.png").write_bytes(block_files.png_bytes(np.zeros((5, 4, 3), np.uint8)))
    pixels = block_files.read_png(spark, str(tmp_path))
    with pytest.raises(Exception, match="multiples of 4"):
        images.compress(pixels).collect()
    with pytest.raises(Exception, match="different sizes"):
        images.compare(pixels, pixels.where(F.col("y") < 4)).collect()


def test_alpha_goes_there_and_back(spark, tmp_path):
    y, x = np.mgrid[0:8, 0:8]
    own = np.stack([x * 30, y * 30, 255 - x * 30, (x + y) * 17], axis=2).astype(np.uint8)
    for codec, far in (("3", 8), ("5", 20)):
        paths = [tmp_path / f"{k}{codec}" for k in ("png", "blocks", "back")]
        for p in paths:
            p.mkdir()
        (paths[0] / "a.png").write_bytes(block_files.png_bytes(own))
        images.main(f"-u{codec}", str(paths[0]), str(paths[1]))
        assert (paths[1] / "a.blk").stat().st_size == 8 + 4 * 16
        images.main(f"-d{codec}", "--", str(paths[1]), str(paths[2]))
        p = block_files.png_pixels((paths[2] / "a.png").read_bytes())[2].astype(int)
        assert abs(p[:, :, 3] - own[:, :, 3]).max() <= far and abs(p - own)[:, :, :3].max() <= 90


def test_options():
    assert images.parsed(["-5u", "a", "-d", "--", "-x"]) == ({"mode": "decompress", "codec": "bc3", "metric": "uniform", "fit": "cluster", "options": "end"}, ["a", "-x"])
    assert images.parsed(["-riw"])[0] == {"mode": "compress", "codec": "bc1", "metric": "perceptual", "fit": "iterative", "weights": "alpha"}
    for word in ("-z", "-rw"):
        with pytest.raises(ValueError):
            images.parsed([word])


def test_fits_by_option(spark, tmp_path):
    draw = np.random.default_rng(5)
    own = draw.integers(0, 256, (16, 16, 4)).astype(np.uint8)
    own[:8, :, 3] = 0
    (tmp_path / "png").mkdir()
    (tmp_path / "png/a.png").write_bytes(block_files.png_bytes(own, True))
    far = {}
    for word in ("-ur", "-u", "-ui", "-uw", "-ui5"):
        images.main(word, str(tmp_path / "png"), str(tmp_path / f"blocks{word}"))
        images.main("-d5" if "5" in word else "-d", str(tmp_path / f"blocks{word}"), str(tmp_path / f"back{word}"))
        p = block_files.png_pixels((tmp_path / f"back{word}/a.png").read_bytes())[2].astype(int)
        far[word] = ((p - own)[:, :, :3] ** 2).sum()
    assert far["-ui"] <= far["-u"] < far["-ur"] and far["-u"] < far["-uw"] and far["-ui"] <= far["-ui5"]


def test_filters_of_many_rows():
    """Rows of one filter are undone together, whatever stands before them; held against one value after another."""
    draw = np.random.default_rng(8)
    for bpp, stride in ((1, 5), (3, 21), (4, 4)):
        rows = draw.integers(0, 256, (300, stride + 1)).astype(np.uint8)
        rows[:, 0] = np.repeat(draw.integers(0, 5, 60), 5)
        want = np.zeros((301, stride + bpp), int)
        for y, (kind, *own) in enumerate(rows.tolist()):
            for x, v in enumerate(own, bpp):
                a, b, c = want[y + 1, x - bpp], want[y, x], want[y, x - bpp]
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                want[y + 1, x] = (v + (0, a, b, (a + b) // 2, near)[kind]) % 256
        assert (block_files.unfiltered(rows.tobytes(), 300, stride, bpp) == want[1:, bpp:]).all()


def test_pages_stay_rows_until_they_are_files(spark, tmp_path):
    """No row for each pixel is shuffled: files and sums come from whole images."""
    draw = np.random.default_rng(9)
    texts = {k: bytes(draw.integers(32, 127, n).tolist()).decode() + "é" * (k % 3) for k, n in enumerate((1, 182, 183, 184, 5000, 70000))} | {-4: "x" * 400}
    spark.createDataFrame([*texts.items(), (90, None), (91, "")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = files.interlaced_round_trip(spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobinPartitioning", "")
    got = {r.page_id: (r.width, r.height, r.pixels, r.sum_r, r.sum_g, r.sum_b) for r in found.collect()}
    want = {}
    for k, t in texts.items():
        data = t.encode()
        p = np.frombuffer(data + b" " * (-len(data) % 183), np.uint8).reshape(-1, 61, 3).astype(int)
        want[k] = (61, len(p), 61 * len(p), *(p * np.arange(1, 62)[:, None] * np.arange(1, len(p) + 1)[:, None, None]).sum((0, 1)).tolist())
    assert got == want


def test_interlaced():
    draw = np.random.default_rng(2)
    for channels in (1, 2, 3, 4):
        for height, width in ((1, 1), (1, 5), (3, 2), (8, 8), (13, 17)):
            own = draw.integers(0, 256, (height, width, channels)).astype(np.uint8)
            for kind in (0, 2):
                assert (block_files.png_pixels(block_files.png_bytes(own, True, kind))[2] == own).all()
    # a palette of four in two bits a pixel, 5 by 3: the passes' rows packed by hand
    own = draw.integers(0, 4, (3, 5))
    rows = b""
    for x, y, right, down in block_files.PASSES:
        for line in own[y::down, x::right]:
            if len(line):
                bits = "".join(f"{v:02b}" for v in line)
                rows += b"\0" + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    head = part(b"IHDR", struct.pack(">IIBBBBB", 5, 3, 2, 3, 0, 0, 1))
    content = block_files.SIGNATURE + head + part(b"PLTE", bytes(range(12))) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")
    assert (block_files.png_pixels(content)[2][:, :, 0] == own * 3).all()


def part(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(width, height, depth, colour, rows, **chunks):
    head = part(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0))
    return block_files.SIGNATURE + head + b"".join(part(k.encode(), v) for k, v in chunks.items()) + part(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + part(b"IEND", b"")


def test_png_is_expanded():
    p = block_files.png_pixels(png(3, 2, 4, 3, [b"\x01\x20", b"\x21\x00"], PLTE=bytes(range(9)), tRNS=b"\x07\x80"))[2]
    assert p.tolist() == [[[0, 1, 2, 7], [3, 4, 5, 128], [6, 7, 8, 255]], [[6, 7, 8, 255], [3, 4, 5, 128], [0, 1, 2, 7]]]
    assert block_files.png_pixels(png(2, 1, 8, 3, [b"\x01\x00"], PLTE=bytes(range(6))))[2].tolist() == [[[3, 4, 5], [0, 1, 2]]]
    assert block_files.png_pixels(png(9, 1, 1, 0, [b"\xa0\x80"]))[2][0, :, 0].tolist() == [255, 0, 255, 0, 0, 0, 0, 0, 255]
    assert block_files.png_pixels(png(3, 1, 2, 0, [b"\x6c"], tRNS=b"\x00\x02"))[2].tolist() == [[[85, 255], [170, 0], [255, 255]]]
    assert block_files.png_pixels(png(2, 1, 8, 2, [bytes([1, 2, 3, 4, 5, 6])], tRNS=b"\0\4\0\5\0\6"))[2].tolist() == [[[1, 2, 3, 255], [4, 5, 6, 0]]]
    with pytest.raises(ValueError):
        block_files.png_pixels(png(1, 1, 16, 0, [b"\0\0"]))


def test_unknown_file_systems_raise(spark):
    one = spark.createDataFrame([("a", bytearray(b"x"))], "name string, content binary")
    with pytest.raises(Exception, match="(?i)nosuch"):
        block_files.write_files(one, "nosuch://place/folder")


def test_one_file_over_several_tasks(spark, tmp_path):
    draw = np.random.default_rng(3)
    for name, size, blocks in (("a", 8, 700), ("b", 8, 5), ("none", 8, 0)):
        (tmp_path / f"{name}.blk").write_bytes(struct.pack("<ii", 4 * blocks, 4) + draw.integers(0, 256, blocks * size).astype(np.uint8).tobytes())
    path = str(tmp_path)
    own, plain = block_files.read_block_ranges(spark, path, 8, 64), block_files.read_blocks(spark, path, 8)
    held = lambda df: sorted((r.path[-5:], r.width, r.height, r.block, tuple(r.c)) for r in df.collect())
    assert own.rdd.getNumPartitions() == 12 and held(own) == held(plain) and len(held(own)) == 705
    some = own.where("block >= 600 and block < 650")
    assert some.rdd.getNumPartitions() == 1 and held(some) == held(plain.where("block >= 600 and block < 650"))
    assert held(own.where("block in (3, 650)")) == held(plain.where("block in (3, 650)"))
    assert held(own.where("block > 4 and block <= 6 or block = 9")) == held(plain.where("block > 4 and block <= 6 or block = 9"))
    assert own.where("block = 1000").collect() == [] and own.where("block < 0").collect() == []
    assert len(block_files.read_block_ranges(spark, str(tmp_path / "a.blk"), 8).collect()) == 700
    (tmp_path / "odd.blk").write_bytes(struct.pack("<ii", 4, 4) + b"123")
    with pytest.raises(Exception, match="whole blocks"):
        block_files.read_block_ranges(spark, path, 8).collect()
    (tmp_path / "odd.blk").write_bytes(struct.pack("<ii", 8, 4) + b"12345678")
    with pytest.raises(Exception, match="whole blocks"):
        block_files.read_block_ranges(spark, path, 8).collect()
