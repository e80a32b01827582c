"""Data sources over whole files: `blobs` writes rows (name, content) as files, `frames` reads videos frame by frame.

    blobs.register(spark)
    sheets.write.format("blobs").mode("append").save("s3://bucket/sheets")
    spark.read.format("frames").load("/videos").filter("frame BETWEEN 100 AND 200")

Paths go through pyarrow's file systems, so they may be local or in an object store; files are never read whole, only the
ranges that a task needs.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .jpeg import decode_jpeg

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
FRAMES_SCHEMA = "video string, frame long, time double, fps double, frames long, image struct<width:int,height:int,channels:int,data:binary>"
#: Frames of an input partition unless the option framesPerPartition says otherwise.
EACH = 64
#: Chroma samples of a Y4M colour space, across and down for one of luma (fixed values).
Y4M_CHROMA = {"420": (2, 2), "420jpeg": (2, 2), "420mpeg2": (2, 2), "420paldv": (2, 2), "422": (2, 1), "444": (1, 1), "mono": None}


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, and let filters on the frame reach the reader."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Blobs)
    spark.dataSource.register(Frames)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# ---------------------------------------------------------------- files out


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class Blobs(DataSource):
    """Files of a folder, one for each row; only for writing, modes append and overwrite (files of other names stay)."""

    @classmethod
    def name(cls) -> str:
        return "blobs"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> BlobWriter:
        return BlobWriter(self.options["path"])


class BlobWriter(DataSourceWriter):
    """Every task writes under names of its own; the driver renames those of the tasks that count. A reader of the folder never
    sees part of a file, and a task that runs twice leaves one. Names that two rows share are an error, found before any rename."""

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), f"_made-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        files, top = _place(self.path)
        out = []
        for row in rows:
            if not row["name"] or "/" in row["name"] or row["name"] in (".", ".."):
                raise ValueError(f"not a file name: {row['name']!r}")
            made = f"{top}/{self.job}/{uuid.uuid4().hex}"
            files.create_dir(f"{top}/{self.job}", recursive=True)
            with files.open_output_stream(made) as f:
                f.write(bytes(row["content"] or b""))
            out.append((made, row["name"]))
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        files, top = _place(self.path)
        done = [x for m in messages if m is not None for x in m.names]
        if len({n for _, n in done}) < len(done):
            self.abort(messages)
            raise ValueError("two rows have the same file name")
        files.create_dir(top, recursive=True)
        for made, name in done:
            files.move(made, f"{top}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, top = _place(self.path)
        if files.get_file_info(f"{top}/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{top}/{self.job}")


# ---------------------------------------------------------------- videos in


@dataclass
class Video:
    """What a video's header says; `index` is left to the tasks."""

    path: str
    kind: str  # y4m or avi
    width: int
    height: int
    fps: float
    frames: int
    start: int  # of the first frame's header, or of the list of frames
    chroma: tuple[int, int] | None = None
    full: bool = False


def _y4m(path: str, head: bytes, size: int) -> Video:
    line = head.split(b"\n", 1)[0]
    given = line.decode("ascii", "replace").split(" ")[1:]
    told = {x[0]: x[1:] for x in given if x and x[0] != "X"}
    colour = told.get("C", "420jpeg")
    if len(line) == len(head) or colour not in Y4M_CHROMA or "W" not in told or "H" not in told:
        raise ValueError(f"unsupported Y4M form: {path}")
    rate = [int(x) for x in told.get("F", "25:1").split(":")]
    video = Video(path, "y4m", int(told["W"]), int(told["H"]), rate[0] / rate[1], 0, len(line) + 1, Y4M_CHROMA[colour], "XCOLORRANGE=FULL" in given or colour == "420jpeg" and "XCOLORRANGE=LIMITED" not in given)
    video.frames = (size - video.start) // (6 + sum(_planes(video)))
    return video


def _planes(video: Video) -> list[int]:
    """Bytes of each plane of a Y4M frame."""
    if video.chroma is None:
        return [video.width * video.height]
    return [video.width * video.height] + [-(-video.width // video.chroma[0]) * -(-video.height // video.chroma[1])] * 2


def _avi(path: str, head: bytes) -> Video:
    """A motion-JPEG AVI from its header: rate and length of the first video stream, and where its frames begin."""
    at, video = 12, None
    while at + 12 <= len(head):
        kind, size = head[at : at + 4], struct.unpack("<I", head[at + 4 : at + 8])[0]
        if kind == b"LIST" and head[at + 8 : at + 12] == b"movi":
            if video is None:
                break
            video.start = at + 8
            return video
        if kind == b"LIST" and head[at + 8 : at + 12] in (b"hdrl", b"strl"):
            at += 12
            continue
        body = head[at + 8 : at + 8 + size]
        if kind == b"strh" and body[:4] == b"vids" and video is None:
            scale, rate, _, length = struct.unpack("<4I", body[20:36])
            video = Video(path, "avi", 0, 0, rate / max(1, scale), length, 0)
        at += 8 + size + size % 2
    raise ValueError(f"unsupported AVI form: {path}")


def opened(path: str) -> Video:
    files, place = _place(path)
    with files.open_input_file(place) as f:
        head, size = f.read(1 << 16), f.size()
    if head.startswith(b"YUV4MPEG2"):
        return _y4m(path, head, size)
    if head[:4] == b"RIFF" and head[8:12] == b"AVI ":
        return _avi(path, head)
    raise ValueError(f"not a Y4M or AVI video: {path}")


@dataclass
class Part(InputPartition):
    video: Video
    first: int
    last: int


class Frames(DataSource):
    """Frames of a video or of all *.y4m and *.avi of a folder: RGB pictures, or grey ones of mono videos."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAMES_SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options["path"], int(self.options.get("framesPerPartition", EACH)))


class FrameReader(DataSourceReader):
    """Partitions are ranges of frames. The driver reads headers only; a range of frames that a filter asks for decides which
    partitions there are, so frames beyond it are neither read nor decoded. Spark applies the filters once more."""

    def __init__(self, path: str, each: int):
        self.path, self.each, self.first, self.last = path, max(1, each), 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("frame",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.last = min(self.last, f.value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> Sequence[Part]:
        files, place = _place(self.path)
        info = files.get_file_info(place)
        if info.type == fs.FileType.Directory:
            paths = sorted(x.path for x in files.get_file_info(fs.FileSelector(place, recursive=True)) if x.type == fs.FileType.File and x.path.lower().endswith((".y4m", ".avi")))
        else:
            paths = [place]
        scheme = re.match(r"[a-z0-9+]+://(?=[^/])", self.path)
        out = []
        for path in paths:
            video = opened(f"{scheme[0]}{path}" if scheme else path)
            last = min(self.last, video.frames - 1)
            out += [Part(video, at, min(at + self.each - 1, last)) for at in range(self.first, last + 1, self.each)]
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        video = part.video
        files, place = _place(video.path)
        with files.open_input_file(place) as f:
            for number, rows in (_y4m_frames if video.kind == "y4m" else _avi_frames)(f, video, part.first, part.last):
                image = rows.shape[1], rows.shape[0], rows.shape[2], rows.tobytes()
                yield video.path.rsplit("/", 1)[-1], number, number / video.fps, video.fps, video.frames, image


def _y4m_frames(f, video: Video, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    sizes = _planes(video)
    step = 6 + sum(sizes)
    for number in range(first, last + 1):
        f.seek(video.start + number * step)
        data = f.read(step)
        if data[:6] != b"FRAME\n" or len(data) < step:
            raise ValueError(f"{video.path}: frames with parameters or of other sizes")
        luma = np.frombuffer(data, np.uint8, sizes[0], 6).reshape(video.height, video.width)
        if video.chroma is None:
            yield number, luma[:, :, None]
            continue
        fx, fy = video.chroma
        chroma = [np.frombuffer(data, np.uint8, sizes[1], 6 + sizes[0] + k * sizes[1]).reshape(-(-video.height // fy), -1) for k in (0, 1)]
        u, v = (np.repeat(np.repeat(c, fy, axis=0), fx, axis=1)[: video.height, : video.width] - 128.0 for c in chroma)
        y = luma.astype(float)
        if not video.full:
            y, u, v = (y - 16) * 255 / 219, u * 255 / 224, v * 255 / 224
        yield number, np.clip(np.rint(np.stack([y + 1.402 * v, y - 0.344136286 * u - 0.714136286 * v, y + 1.772 * u], axis=2)), 0, 255).astype(np.uint8)


def _avi_frames(f, video: Video, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """Frames by the file's index, or by walking the chunks' headers where it has none."""
    for number, (at, size) in enumerate(_avi_index(f, video)[first : last + 1], first):
        f.seek(at)
        rows, _ = decode_jpeg(f.read(size))
        yield number, rows


def _avi_index(f, video: Video) -> list[tuple[int, int]]:
    """(place, bytes) of every frame of the first video stream."""
    f.seek(video.start - 4)
    end = video.start + struct.unpack("<I", f.read(4))[0]
    f.seek(end + (end - video.start) % 2)
    head = f.read(8)
    if head[:4] == b"idx1":
        table = np.frombuffer(f.read(struct.unpack("<I", head[4:])[0]), np.dtype([("kind", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
        table = table[np.isin(table["kind"], [b"00dc", b"00db"])]
        # places count from the list's name in some files, from the file's start in others
        base = 0 if table.size and table["at"][0] >= video.start else video.start
        return [(base + int(a) + 8, int(s)) for a, s in zip(table["at"], table["size"], strict=True)]
    out, at = [], video.start + 4
    while at + 8 <= end:
        f.seek(at)
        kind, size = struct.unpack("<4sI", f.read(8))
        if kind == b"LIST":
            at += 12
            continue
        if kind in (b"00dc", b"00db"):
            out.append((at + 8, size))
        at += 8 + size + size % 2
    return out
