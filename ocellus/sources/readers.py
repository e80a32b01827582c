"""Sources: annotation CSVs, manifests, picture folders, ring geometry, sidecars, centres, capture metadata, logs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import raise_unless, require_columns
from .jpeg import decode_jpeg

ANNOTATION_COLUMNS = ["filename", "file_size", "annotation_count", "annotation_ID", "attributes", "shape_coordinates"]
MANIFEST_COLUMNS = ["filename", "image_path", "label", "pixel_sha256", "duplicate_group", "issues"]
MOST_BYTES = 15 << 20


def csv(spark: SparkSession, path: str | list[str], required: Sequence[str] = ()) -> DataFrame:
    """Header CSV, every value a string; a byte-order mark at the first name is dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    return require_columns(df, required)


def frame_tables(spark: SparkSession, folder: str, name: str = "*", order: Sequence[str] = ("time",)) -> DataFrame:
    """The header CSVs frame_<number>/<name> of a folder as one table with the frame's number, in order of `order` and then of the
    frame; frames without a file are left out."""
    df = spark.read.csv(f"{folder.rstrip('/')}/frame_*/{name}", header=True, escape='"', inferSchema=True)
    frame = F.regexp_extract(F.col("_metadata.file_path"), r"/frame_(\d+)/", 1).cast("long")
    return df.select("*", frame.alias("frame")).orderBy(*order, "frame")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Typed annotation rows; malformed JSON, a missing lesion or region, a non-integer count or an unsafe name fails the read."""
    raw = csv(spark, path, ANNOTATION_COLUMNS)
    attributes, shape = F.from_json("attributes", "lesion STRING, region STRING"), F.from_json("shape_coordinates", "name STRING, x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE")
    out = raw.select("filename", *(F.col(c).try_cast("int").alias(c) for c in ("file_size", "annotation_count", "annotation_ID")), attributes.alias("attributes"), shape.alias("box"))
    out = raise_unless(out, F.col("attributes.lesion").isNotNull() & F.col("attributes.region").isNotNull(), "Missing lesion or region")
    out = raise_unless(out, F.col("annotation_count").isNotNull() & F.col("annotation_ID").isNotNull(), "Annotation counts and ids must be integers")
    return raise_unless(out, ~F.col("filename").rlike(r"[/\\:]") & ~F.col("filename").isin("", ".", ".."), "Unsafe file name")


def manifest(spark: SparkSession, path: str, required: Sequence[str] = MANIFEST_COLUMNS, split: str | None = None) -> DataFrame:
    """Manifest rows with an integer label of 0 or 1; names must be unique, and all rows of the split if one is given."""
    df = csv(spark, path, required)
    if not df.groupBy("filename").count().filter("count > 1").isEmpty():
        raise ValueError("the manifest repeats a file name")
    df = raise_unless(df, F.col("label").isin("0", "1"), "labels must be 0 or 1").withColumn("label", F.col("label").cast("int"))
    return df if split is None else raise_unless(df, F.col("split") == split, f"a row is not of the split {split}")


def files(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """Files of a folder tree (path, name, length, content) without AppleDouble companions, by name and by magic bytes. Spark leaves out files of length 0."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", name.alias("name"), "length", "content").filter(~F.col("name").startswith("._") & (F.hex(F.substring("content", 1, 4)) != "00051607"))


def class_folders(spark: SparkSession, folder: str, classes: Sequence[str], pattern: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """Files with the label of the class folder they are in."""
    label = F.element_at(F.split("path", "/"), -2)
    return files(spark, folder, pattern).withColumn("class_name", label).filter(F.col("class_name").isin(*classes)).withColumn("label", F.array_position(F.array(*map(F.lit, classes)), F.col("class_name")).cast("int") - 1)


#: First column and row of each pass of an interlaced PNG, and the steps between its columns and rows (fixed values).
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _chunks(data: bytes) -> dict[bytes, bytes]:
    """A PNG's chunks by kind, those of one kind end to end."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, found = 8, {}
    while at + 8 <= len(data) and b"IEND" not in found:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        found[kind] = found.get(kind, b"") + body
        at += 12 + size
    return found


def _lines(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes without their filters; `step` bytes back is the same byte of the pixel before."""
    out = np.zeros((raw.shape[0] + 1, raw.shape[1] - 1), np.uint8)
    for y, (kind, line) in enumerate(zip(raw[:, 0].tolist(), raw[:, 1:], strict=True)):
        up, row = out[y], out[y + 1]
        if kind in (0, 2):
            row[:] = line + up if kind else line
        elif kind == 1:
            for c in range(step):
                row[c::step] = np.cumsum(line[c::step], dtype=np.uint8)
        elif kind in (3, 4):
            for i in range(0, line.size, step):
                left = row[i - step : i].astype(int) if i else np.zeros(step, int)
                above = up[i : i + step].astype(int)
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    corner = up[i - step : i].astype(int) if i else np.zeros(step, int)
                    far = np.abs(np.stack([above - corner, left - corner, left + above - 2 * corner]))
                    guess = np.choose(far.argmin(0), [left, above, corner])
                row[i : i + step] = line[i : i + step] + guess.astype(np.uint8)
        else:
            raise ValueError("unknown row filter")
    return out[1:]


def orientation(exif: bytes) -> int:
    """The orientation that an EXIF block names, 1 if none."""
    order = {b"II": "<", b"MM": ">"}.get(exif[:2])
    if order is None or len(exif) < 8:
        return 1
    start = struct.unpack(order + "I", exif[4:8])[0]
    for at in range(start + 2, start + 2 + 12 * (struct.unpack(order + "H", exif[start : start + 2])[0] if start + 2 <= len(exif) else 0), 12):
        if at + 12 <= len(exif) and struct.unpack(order + "HH", exif[at : at + 4]) == (0x0112, 3):
            return struct.unpack(order + "H", exif[at + 8 : at + 10])[0]
    return 1


def upright(rows: np.ndarray, turn: int) -> np.ndarray:
    """A picture turned and mirrored as its orientation (1 to 8) says."""
    if turn in (5, 7):
        rows = rows.swapaxes(0, 1)
    rows = np.rot90(rows, {3: 2, 6: -1, 7: 2, 8: 1}.get(turn, 0))
    return rows[:, ::-1] if turn == 2 else rows[::-1] if turn == 4 else rows


def decode_png(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """Width, height, channels and rows (8 bits a sample) of a PNG of any colour type, depth and interlacing, upright by its EXIF
    orientation. Palettes become RGB, or RGBA if they have transparency."""
    found = _chunks(data)
    if len(found.get(b"IHDR", b"")) != 13 or b"IDAT" not in found:
        raise ValueError("unsupported PNG form")
    width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", found[b"IHDR"])
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if samples is None or depth not in (1, 2, 4, 8, 16) or (depth < 8 and samples > 1) or laced > 1:
        raise ValueError("unsupported PNG form")
    raw, at = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8), 0
    out = np.zeros((height, width, samples), np.uint8)
    for x0, y0, dx, dy in PASSES if laced else [(0, 0, 1, 1)]:
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        size = 1 + -(-w * samples * depth // 8)
        lines = _lines(raw[at : at + h * size].reshape(h, size), max(1, samples * depth // 8))
        at += h * size
        if depth == 16:
            lines = lines[:, ::2]
        elif depth < 8:
            bits = np.unpackbits(lines, axis=1)[:, : w * depth].reshape(h, w, depth)
            lines = bits @ (1 << np.arange(depth)[::-1]).astype(np.uint8)
            lines = lines * np.uint8(255 // ((1 << depth) - 1)) if colour == 0 else lines
        out[y0::dy, x0::dx] = lines.reshape(h, w, samples)
    if colour == 3:
        palette = np.frombuffer(found.get(b"PLTE", b""), np.uint8).reshape(-1, 3)
        if out.max(initial=0) >= len(palette):
            raise ValueError("a colour is not in the palette")
        if b"tRNS" in found:
            clear = np.frombuffer(found[b"tRNS"], np.uint8)
            palette = np.c_[palette, np.r_[clear, np.full(max(0, len(palette) - clear.size), 255, np.uint8)][: len(palette)]]
        out = palette[out[:, :, 0]]
    out = np.ascontiguousarray(upright(out, orientation(found.get(b"eXIf", b""))))
    return out.shape[1], out.shape[0], out.shape[2], out


def decode(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """Width, height, channels and rows of a PNG or JPEG, known by its first bytes, upright by its EXIF orientation."""
    if data[:2] != b"\xff\xd8":
        return decode_png(data)
    rows, exif = decode_jpeg(data)
    rows = np.ascontiguousarray(upright(rows, orientation(exif)))
    return rows.shape[1], rows.shape[0], rows.shape[2], rows


def decoded(df: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds image (width, height, channels, data) or error; an empty, too large or unreadable file has a null image."""

    def run(batches):
        for pdf in batches:
            images, errors = [], []
            for content in pdf["content"]:
                try:
                    if not content:
                        raise ValueError("empty file")
                    if len(content) > most_bytes:
                        raise ValueError("file too large")
                    w, h, c, rows = decode(bytes(content))
                    images.append({"width": w, "height": h, "channels": c, "data": rows.tobytes()})
                    errors.append(None)
                except (ValueError, struct.error, zlib.error) as e:
                    images.append(None)
                    errors.append(str(e))
            yield pdf.drop(columns="content").assign(image=images, error=errors)

    kept = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != "content")
    return df.mapInPandas(run, f"{kept}, image struct<width:int,height:int,channels:int,data:binary>, error string")


def pixels(df: DataFrame, key: str) -> DataFrame:
    """Rows (key, y, x, r, g, b) of decoded images; grey pictures repeat their value."""

    def run(batches):
        for pdf in batches:
            for k, image in zip(pdf[key], pdf["image"], strict=True):
                if image is None or image["data"] is None:  # beside others a null struct comes as one of nulls
                    continue
                w, h, c = int(image["width"]), int(image["height"]), int(image["channels"])
                rows = np.frombuffer(image["data"], np.uint8).reshape(h * w, c).astype(np.int16)
                rgb = rows[:, :3] if c >= 3 else np.repeat(rows[:, :1], 3, axis=1)
                y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
                yield pd.DataFrame({key: k, "y": y, "x": x, "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2]})

    return df.select(key, "image").mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, y int, x int, r short, g short, b short")


def frame_grid(frames: DataFrame, video: str, time: str, step: float = 0.25) -> DataFrame:
    """For each grid time of a video the frame nearest to it, the earlier of equals."""
    cell = F.floor(F.col(time) / step)
    at = frames.withColumn("grid", F.explode(F.array(cell, cell + 1))).withColumn("_off", F.abs(F.col(time) - F.col("grid") * step)).filter(F.col("_off") <= step)
    row = F.struct(*(F.col(c) for c in frames.columns if c != video))
    best = at.groupBy(video, "grid").agg(F.min_by(row, F.struct("_off", time)).alias("r"))
    return best.select(video, (F.col("grid") * step).alias("grid_time"), "r.*")


def ring_geometry(spark: SparkSession, path: str, midpoints: bool = False, thickness: float = 2.0, adjustment: float = 0.5) -> DataFrame:
    """Ring number, radius and height from lines of two numbers, the first line left out; optionally also a ring half
    way to the next one, `adjustment` off in height. A file of some dozens of lines."""
    from pyspark.sql import Window

    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    part = F.split(F.trim("value"), r"\s+")
    rows = lines.select("line", F.get(part, F.lit(0)).cast("double").alias("radius"), F.get(part, F.lit(1)).cast("double").alias("height"))
    by_line = Window.orderBy("line")
    rows = rows.withColumn("k", F.row_number().over(by_line)).filter("k > 1")
    if midpoints:
        between = rows.select("line", "k", ((F.col("radius") + F.lead("radius").over(by_line)) / 2).alias("radius"), ((F.col("height") + F.lead("height").over(by_line)) / 2 - adjustment * thickness / 2).alias("height"))
        rows = rows.withColumn("at", F.lit(0)).unionByName(between.filter("radius IS NOT NULL").withColumn("at", F.lit(1)))
        return rows.select((F.row_number().over(Window.orderBy("line", "at")) - 1).alias("mire_num"), "radius", "height")
    return rows.select((F.col("k") - 2).alias("mire_num"), "radius", "height")


def polar_sidecars(spark: SparkSession, path: str, value: str = "intensity") -> DataFrame:
    """Long table (file, mire_num, angle, value) from JSON files {ring: {angle: number}}."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "MAP<STRING, MAP<STRING, DOUBLE>>").alias("m"))
    rings = whole.select("file", F.explode("m").alias("ring", "a"))
    return rings.select("file", F.col("ring").cast("int").alias("mire_num"), F.explode("a").alias("angle", value)).withColumn("angle", F.col("angle").cast("double"))


def review_decisions(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, decision) with a < b from a document of confirmed_pairs and rejected_pairs."""
    df = spark.read.schema("confirmed_pairs ARRAY<ARRAY<STRING>>, rejected_pairs ARRAY<ARRAY<STRING>>").json(path, multiLine=True)
    each = [df.select(F.explode(f"{kind}_pairs").alias("p"), F.lit(kind).alias("decision")).withColumn("p", F.array_sort("p")) for kind in ("confirmed", "rejected")]
    return each[0].unionByName(each[1]).select(F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b"), "decision")


def centres(spark: SparkSession, path: str) -> DataFrame:
    """image_name, cx, cy from lines of a name and two numbers."""
    part = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(F.get(part, F.lit(0)).alias("image_name"), F.get(part, F.lit(1)).cast("double").alias("cx"), F.get(part, F.lit(2)).cast("double").alias("cy"))


def capture_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Capture rows with the sensor's larger and smaller side, focal length and marked centre as numbers."""
    sides = F.array_sort(F.transform(F.split("camera_physical_size", "x"), lambda s: s.cast("double")))
    marked = F.split("marked_center", r"\|")
    df = csv(spark, path, ["image_name", "camera_physical_size", "focal_length", "marked_center"])
    return df.select("image_name", F.col("focal_length").cast("double").alias("focal_length"), F.get(sides, F.lit(1)).alias("sensor_long"), F.get(sides, F.lit(0)).alias("sensor_short"), F.get(marked, F.lit(0)).try_cast("double").alias("cx"), F.get(marked, F.lit(1)).try_cast("double").alias("cy"))


def logged_values(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(image, value) of log lines "<image> <name>: <number>"."""
    found = F.regexp_extract("value", rf"(\S+) {name}: (-?[0-9.]+(?:[eE][-+]?[0-9]+)?)", 1)
    number = F.regexp_extract("value", rf"(\S+) {name}: (-?[0-9.]+(?:[eE][-+]?[0-9]+)?)", 2)
    return spark.read.text(path).select(found.alias("image"), number.try_cast("double").alias("value")).filter("image <> ''")


def paired_by_stem(first: DataFrame, second: DataFrame) -> DataFrame:
    """Files of two folders that share the name without its suffix."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return first.withColumn("stem", stem).select("stem", F.col("content").alias("first")).join(second.withColumn("stem", stem).select("stem", F.col("content").alias("second")), "stem")


def verified(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Files against a manifest (name, length, crc32): ok, missing, size or checksum."""
    got = df.select("name", F.col("length").alias("_l"), F.crc32("content").alias("_c"))
    status = F.when(F.col("_l").isNull(), "missing").when(F.col("_l") != F.col("length"), "size").when(F.col("_c") != F.col("crc32"), "checksum").otherwise("ok")
    return expected.join(got, "name", "left").select("name", status.alias("status"))


def pixel_digest(width: Column, height: Column, data: Column) -> Column:
    """SHA-256 over "<width>x<height>:RGB:" and the pixel bytes."""
    return F.sha2(F.concat(F.encode(F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit(":RGB:")), "UTF-8"), data), 256)


def gated_threshold(spark: SparkSession, model: str, summary: str) -> float:
    """The decision threshold that a model's summary (a JSON document) gives, if the summary lets the model pass: an experimental one
    must name the digest of the model's file, an accepted one must say that the test set was not touched."""
    rows = spark.read.schema("status STRING, model_sha256 STRING, threshold DOUBLE, corrected STRUCT<threshold: DOUBLE>, test_set_inference_performed BOOLEAN").json(summary, multiLine=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a model has one summary")
    told = rows[0]
    if told["status"] == "experimental_research_only":
        digests = [r["d"] for r in spark.read.format("binaryFile").load(model).select(F.sha2("content", 256).alias("d")).limit(2).collect()]
        if digests != [told["model_sha256"]]:
            raise ValueError("the model is not the one of its summary")
        threshold = told["threshold"]
    elif told["status"] == "accepted" and told["test_set_inference_performed"] is False:
        threshold = told["corrected"]["threshold"] if told["corrected"] else None
    else:
        raise ValueError("the model has not passed its gate")
    if threshold is None or not 0 < threshold < 1:
        raise ValueError("the threshold must be between 0 and 1")
    return threshold
