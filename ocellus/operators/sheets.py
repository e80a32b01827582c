"""Review sheets: a group's pictures, fitted into the cells of pages, as PNG files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WHITE = 255


def encode_png(rows: np.ndarray, comment: str = "") -> bytes:
    """An 8-bit PNG of rows (height, width, 1, 3 or 4); each line is stored with the filter whose bytes are smallest in sum."""
    height, width, channels = rows.shape
    flat = rows.reshape(height, width * channels).astype(np.int16)
    left = np.pad(flat, ((0, 0), (channels, 0)))[:, : width * channels]
    up = np.r_[np.zeros((1, flat.shape[1]), np.int16), flat[:-1]]
    tried = np.stack([flat, flat - left, flat - up, flat - (left + up) // 2]).astype(np.uint8)
    cost = np.minimum(tried.astype(int), 256 - tried.astype(int)).sum(axis=2)
    best = cost.argmin(axis=0)
    lines = np.c_[best.astype(np.uint8), tried[best, np.arange(height)]]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    text = chunk(b"iTXt", b"Comment\0\0\0\0\0" + comment.encode()) if comment else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + text + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def _weights(size: int, to: int) -> np.ndarray:
    """Three-lobed Lanczos weights (to, size) of a line of `size` samples brought to `to`, wider when it shrinks."""
    step = size / to
    wide = max(step, 1.0)
    at = (np.arange(to)[:, None] + 0.5) * step
    x = (np.arange(size)[None] + 0.5 - at) / wide
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resized(rows: np.ndarray, width: int, height: int) -> np.ndarray:
    """Columns first, then lines, rounded to levels after each."""
    level = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    out = rows.astype(float)
    if rows.shape[1] != width:
        out = level(np.einsum("yxc,wx->ywc", out, _weights(rows.shape[1], width), optimize=True))
    if rows.shape[0] != height:
        out = level(np.einsum("yxc,hy->hxc", out, _weights(rows.shape[0], height), optimize=True))
    return out.astype(np.uint8)


def fitted(rows: np.ndarray, width: int, height: int) -> np.ndarray:
    """The picture in RGB, as large as the box holds in its own proportions, in the middle of white."""
    rgb = rows[:, :, :3] if rows.shape[2] >= 3 else np.repeat(rows[:, :, :1], 3, axis=2)
    h, w = rgb.shape[:2]
    if w * height > h * width:
        to = width, max(1, round(h / w * width))
    else:
        to = max(1, round(w / h * height)), height
    out = np.full((height, width, 3), WHITE, np.uint8)
    x, y = (width - to[0]) // 2, (height - to[1]) // 2
    out[y : y + to[1], x : x + to[0]] = resized(rgb, *to)
    return out


def framed(rows: np.ndarray, boxes: Sequence[tuple[float, float, float, float]], colour: tuple[int, int, int] = (255, 0, 0)) -> np.ndarray:
    """Boxes (x, y, width, height) drawn inwards as lines max(3, width // 500) wide; parts beyond the picture are left out."""
    out = (rows[:, :, :3] if rows.shape[2] >= 3 else np.repeat(rows[:, :, :1], 3, axis=2)).copy()
    thick = max(3, out.shape[1] // 500)
    y, x = np.mgrid[: out.shape[0], : out.shape[1]]
    for left, top, w, h in boxes:
        x0, y0, x1, y1 = int(left), int(top), int(left + w), int(top + h)
        inside = (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)
        out[inside & ((x < x0 + thick) | (x > x1 - thick) | (y < y0 + thick) | (y > y1 - thick))] = colour
    return out


def sheets(pictures: DataFrame, group: str, key: str, images: Sequence[str], columns: int, lines: int, tile: tuple[int, int], box: tuple[int, int], places: Sequence[tuple[int, int]], boxes: str | None = None) -> DataFrame:
    """group, page, name and content (PNG) of every page of a group's pictures, columns * lines cells a page in order of the key.

    Each cell is `tile` pixels and shows the row's images, fitted into `box`, at `places`; a null image stays white. With `boxes`
    (an array of x, y, width, height) they are drawn on the first image. The keys of a page, line by line, are its comment.
    Rows are numbered without their pictures, and a page is a group of its own, so a group of any size is drawn in parallel.
    """
    order = Window.partitionBy(group).orderBy(key)
    page = pictures.select(group, key).withColumn("_n", F.row_number().over(order) - 1)
    page = page.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.floor(F.col("_n") / (columns * lines)).cast("int").alias("page"), (F.col("_n") % (columns * lines)).alias("_cell"))
    told = pictures.select(group, F.col(key).alias("_key"), *images, *([boxes] if boxes else []))
    cells = told.join(page, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_key") == F.col("_k"))).drop("_g", "_k")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.full((tile[1] * lines, tile[0] * columns, 3), WHITE, np.uint8)
        pdf = pdf.sort_values("_cell")
        for row in pdf.to_dict("records"):
            y, x = row["_cell"] // columns * tile[1], row["_cell"] % columns * tile[0]
            for k, (image, (dx, dy)) in enumerate(zip(images, places, strict=True)):
                got = row[image]
                if got is None or got["data"] is None:
                    continue
                rows = np.frombuffer(got["data"], np.uint8).reshape(int(got["height"]), int(got["width"]), int(got["channels"]))
                if boxes and k == 0 and row[boxes] is not None:
                    rows = framed(rows, [(b["x"], b["y"], b["width"], b["height"]) for b in row[boxes]])
                out[y + dy : y + dy + box[1], x + dx : x + dx + box[0]] = fitted(rows, *box)
        g, p = pdf[group].iloc[0], int(pdf["page"].iloc[0])
        return pd.DataFrame({group: [g], "page": [p], "name": [f"{g}-{p}.png"], "content": [encode_png(out, "\n".join(map(str, pdf["_key"])))]})

    kind = pictures.schema[group].dataType.simpleString()
    return cells.groupBy(group, "page").applyInPandas(draw, f"`{group}` {kind}, page int, name string, content binary")
