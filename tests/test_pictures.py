"""JPEG pictures, videos and review sheets against known pixels."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import jpeg_writer as J

from ocellus.operators import sheets, signal
from ocellus.sources import blobs, jpeg, readers

R = np.random.default_rng(6)


def noise(shape, most=40):
    out = np.rint(R.laplace(0, 3, (*shape, 64)) * (R.random((*shape, 64)) < 0.3)).astype(int)
    out[R.random(shape) < 0.3] = 0
    out[..., 0] = R.integers(-most, most, shape)
    out[..., 63] *= R.random(shape) < 0.1
    return out


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("restart", [0, 2])
@pytest.mark.parametrize(("width", "height"), [(40, 24), (33, 17), (5, 3)])
def test_jpeg_grey(progressive, restart, width, height):
    quant = R.integers(1, 6, 64)
    plane = noise((-(-height // 8), -(-width // 8)))
    rows, exif = jpeg.decode_jpeg(J.write([plane], [(1, 1)], width, height, quant, progressive, restart))
    want = np.clip(J.samples(plane, quant), 0, 255)[:height, :width]
    assert exif == b"" and rows.shape == (height, width, 1) and np.abs(rows[:, :, 0] - want).max() <= 0.51


def rgb(y, cb, cr):
    return np.clip(np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=2), 0, 255)


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("sampling", [[(1, 1)] * 3, [(2, 1), (1, 1), (1, 1)], [(2, 2), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)], [(4, 1), (1, 1), (2, 1)]])
def test_jpeg_colour(progressive, sampling):
    """A picture of smooth colours comes back close to itself, however its chroma was stored."""
    width, height, quant = 60, 44, np.ones(64, int)
    y, x = np.mgrid[:64, :64]
    planes = [128 + 60 * np.sin(x / 9) + 20 * np.cos(y / 5), 128 + 0.9 * (x - 30), 128 - 0.8 * (y - 20)]
    most = max(h for h, _ in sampling), max(v for _, v in sampling)
    small = [p.reshape(64 // fy, fy, 64 // fx, fx).mean((1, 3)) for p, (h, v) in zip(planes, sampling, strict=True) for fx, fy in [(most[0] // h, most[1] // v)]]
    coded = [J.blocks_of(p, quant) for p in small]
    rows, _ = jpeg.decode_jpeg(J.write(coded, sampling, width, height, quant, progressive, 3))
    if most == (1, 1):  # nothing between the stored samples and the picture but rounding
        assert np.abs(rows - rgb(*(np.clip(np.rint(J.samples(p, quant)), 0, 255) for p in coded))[:height, :width]).max() <= 0.51
    inner = np.abs(rows.astype(float) - rgb(*planes)[:height, :width])
    assert rows.shape == (height, width, 3) and inner[4:-4, 4:-4].max() <= (6 if sampling[0] == (4, 1) else 3.5)


def test_jpeg_forms(spark):
    """Letters R, G, B mean no transform; four inks; EXIF turns; damaged files have an error and no image."""
    quant, flat = np.full(64, 8), lambda v: np.r_[[v - 128], np.zeros(63, int)].reshape(1, 1, 64)
    plain = J.write([flat(v) for v in (200, 90, 30)], [(1, 1)] * 3, 8, 8, quant, idents=tuple(b"RGB"))
    assert jpeg.decode_jpeg(plain)[0][0, 0].tolist() == [200, 90, 30]
    ink = J.write([flat(v) for v in (200, 100, 50, 255)], [(1, 1)] * 4, 8, 8, quant, extra=J.segment(0xEE, b"Adobe" + bytes(7)))
    assert jpeg.decode_jpeg(ink)[0][0, 0].tolist() == [200, 100, 50]
    turned = J.segment(0xE1, b"Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0")
    wide = J.write([np.concatenate([flat(20), flat(220)], axis=1)], [(1, 1)], 16, 8, quant, extra=turned)
    w, h, c, rows = readers.decode(wide)
    assert (w, h, c) == (8, 16, 1) and rows[0, 0, 0] == 20 and rows[15, 0, 0] == 220
    broken = [wide[:-20], wide[:40], b"\xff\xd8", plain.replace(b"\xff\xc0", b"\xff\xc9"), wide[:30] + b"\0" * 40, b""]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate([wide, plain, *broken])], "id int, content binary")
    got = {r["id"]: r for r in readers.decoded(df).collect()}
    assert [got[i]["image"] is not None and got[i]["image"]["data"] is not None for i in range(8)] == [True, True] + [False] * 6
    assert all(got[i]["error"] for i in range(2, 8)) and bytes(got[1]["image"]["data"][:3]) == bytes([200, 90, 30])


# ---------------------------------------------------------------- files, videos, sheets


def avi(frames, fps, index=True, first=b"00dc"):
    pack = lambda kind, body: kind + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    header = b"vidsMJPG" + bytes(12) + (1).to_bytes(4, "little") + fps.to_bytes(4, "little") + bytes(4) + len(frames).to_bytes(4, "little") + bytes(20)
    movi, table = b"movi", b""
    for data in frames:
        table += first + (16).to_bytes(4, "little") + len(movi).to_bytes(4, "little") + len(data).to_bytes(4, "little")
        movi += pack(first, data)
    body = b"AVI " + pack(b"LIST", b"hdrl" + pack(b"avih", bytes(56)) + pack(b"LIST", b"strl" + pack(b"strh", header))) + pack(b"JUNK", b"abc") + pack(b"LIST", movi)
    return pack(b"RIFF", body + (pack(b"idx1", table) if index else b""))


def test_blobs_are_written_once(spark, tmp_path):
    blobs.register(spark)
    rows = [(f"f{i}.bin", bytearray(R.bytes(i * 7))) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(4)
    df.write.format("blobs").mode("append").save(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(n for n, _ in rows)
    assert all((tmp_path / "out" / n).read_bytes() == bytes(b) for n, b in rows)
    for bad in ([("a", bytearray(b"1"))] * 2, [("../x", bytearray(b"1"))], [(None, bytearray(b"1"))]):
        with pytest.raises(Exception, match="name"):
            spark.createDataFrame(bad, "name string, content binary").write.format("blobs").mode("append").save(f"file://{tmp_path}/bad")
    assert not (tmp_path / "bad").exists() or not any((tmp_path / "bad").iterdir())


@pytest.mark.parametrize(("colour", "fx", "fy"), [("mono", 0, 0), ("444", 1, 1), ("420jpeg", 2, 2), ("422", 2, 1)])
def test_y4m_frames(spark, tmp_path, colour, fx, fy):
    blobs.register(spark)
    frames = []
    for k in range(10):
        y = np.full((5, 7), 16 + 20 * k, np.uint8)
        chroma = b"" if not fx else bytes([128 + k]) * (-(-7 // fx) * -(-5 // fy)) + bytes([128 - k]) * (-(-7 // fx) * -(-5 // fy))
        frames.append(b"FRAME\n" + y.tobytes() + chroma)
    (tmp_path / "v.y4m").write_bytes(f"YUV4MPEG2 W7 H5 F30000:1001 Ip A1:1 C{colour} XCOLORRANGE=FULL\n".encode() + b"".join(frames))
    (tmp_path / "note.txt").write_text("no video")
    df = spark.read.format("frames").option("framesPerPartition", 3).load(str(tmp_path))
    got = df.orderBy("frame").collect()
    assert [r["frame"] for r in got] == list(range(10)) and got[3]["frames"] == 10 and got[3]["time"] == pytest.approx(3 * 1001 / 30000)
    pixel = [np.frombuffer(r["image"]["data"], np.uint8).reshape(5, 7, -1)[4, 6] for r in got]
    want = [[16 + 20 * k] if not fx else np.rint(np.clip([16 + 20 * k - 1.402 * k, 16 + 20 * k - 0.344136 * k + 0.714136 * k, 16 + 20 * k + 1.772 * k], 0, 255)) for k in range(10)]
    assert all(np.abs(a.astype(float) - b).max() <= 0.01 for a, b in zip(pixel, want, strict=True))
    some = df.filter("frame > 4 AND frame <= 7 AND video = 'v.y4m'")
    assert sorted(r["frame"] for r in some.collect()) == [5, 6, 7] and some.rdd.getNumPartitions() == 1  # the others were never planned
    assert sorted(r["frame"] for r in signal.sampled_frames(df, "frame", 4, 2, 9).collect()) == [3, 7]


def test_avi_frames(spark, tmp_path):
    blobs.register(spark)
    quant, flat = np.full(64, 8), lambda v: np.r_[[v - 128], np.zeros(63, int)].reshape(1, 1, 64)
    stills = [J.write([flat(20 * k) for _ in range(3)], [(1, 1)] * 3, 8, 8, quant, idents=tuple(b"RGB")) for k in range(9)]
    for name, index in (("a.avi", True), ("b.avi", False)):
        (tmp_path / name).write_bytes(avi(stills, 12, index))
    got = spark.read.format("frames").option("framesPerPartition", 4).load(str(tmp_path)).filter("frame >= 2").orderBy("video", "frame").collect()
    assert [(r["video"], r["frame"], r["image"]["data"][0], r["fps"]) for r in got] == [(n, k, 20 * k, 12.0) for n in ("a.avi", "b.avi") for k in range(2, 9)]
    (tmp_path / "bad.avi").write_bytes(b"RIFFxxxxAVI nothing")
    with pytest.raises(Exception, match="unsupported AVI"):
        spark.read.format("frames").load(str(tmp_path / "bad.avi")).collect()


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_round_trip(channels):
    for shape in ((1, 1), (7, 13), (40, 33)):
        rows = R.integers(0, 256, (*shape, channels)).astype(np.uint8) if shape[0] < 40 else np.add.outer(np.arange(40), np.arange(33))[:, :, None].repeat(channels, 2).astype(np.uint8)
        w, h, c, back = readers.decode(sheets.encode_png(rows, "öne\ntwo"))
        assert (h, w, c) == rows.shape and (back == rows).all()


def test_fitting_and_boxes():
    flat = np.full((6, 10, 1), 90, np.uint8)
    out = sheets.fitted(flat, 5, 5)
    assert out.shape == (5, 5, 3) and (out[1:4] == 90).all() and (out[[0, 4]] == 255).all()
    ramp = np.arange(0, 240, 4).astype(np.uint8).reshape(1, 60, 1).repeat(4, 0)
    half = sheets.resized(ramp, 30, 4)[0, :, 0].astype(float)
    assert np.abs(half[3:-3] - (8 * np.arange(30) + 2)[3:-3]).max() <= 1  # a ramp stays a ramp
    boxed = sheets.framed(np.zeros((20, 30, 3), np.uint8), [(4, 5, 10, 10), (25, 15, 50, 50)])
    assert (boxed[5, 4:15] == (255, 0, 0)).all() and (boxed[10, 8:11] == 0).all() and (boxed[15:18, 25:] == (255, 0, 0)).all()


def test_sheets(spark):
    picture = lambda v, h, w: {"width": w, "height": h, "channels": 1, "data": bytearray(bytes([v]) * (h * w))}
    rows = [("a" if i < 5 else None, i, picture(10 * i, 4, 4) if i != 3 else None, picture(200, 2, 4)) for i in range(7)]
    kind = "struct<width:int,height:int,channels:int,data:binary>"
    df = spark.createDataFrame(rows, f"g string, id int, one {kind}, two {kind}")
    got = {(r["g"], r["page"]): readers.decode(bytes(r["content"]))[3] for r in sheets.sheets(df, "g", "id", ["one", "two"], 2, 2, (12, 6), (4, 4), [(1, 1), (7, 1)]).collect()}
    assert set(got) == {("a", 0), ("a", 1), (None, 0)} and all(x.shape == (12, 24, 3) for x in got.values())
    first = got["a", 0]
    assert (first[1:5, 13:17] == 10).all() and (first[7:11, 1:5] == 20).all() and (first[7:11, 13:17] == 255).all() and (first[2:4, 7:11] == 200).all() and (first[1, 7:11] == 255).all()
    assert (got["a", 1][1:5, 1:5] == 40).all() and (got["a", 1][1:5, 13:17] == 255).all() and (got[None, 0][1:5, 13:17] == 60).all()
