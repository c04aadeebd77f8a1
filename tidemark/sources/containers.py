"""Media containers: what their headers tell, and the frames of uncompressed video.

RIFF (WAVE, AVI) and ISO base media files are trees of boxes, each with its size. The walk reads
headers and jumps over what it does not need by byte ranges, so a probe of a film costs its
tables and not its pictures. Three Python data sources stand on it, with a partition a file:
`media_probe`, a row a file; `frame_index`, a row a frame with its byte range; `frames`, the
pictures in sequence. Rows of an index may be split and joined like any others, and
read_frames() then reads single frames by their ranges: seeking by number or by time is a join.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions import scalar
from tidemark.sources import store

ENDINGS = (".wav", ".avi", ".mp4", ".mov", ".m4a")
#: Bytes of pictures in a batch of rows.
BATCH = 8 << 20
#: Names of sound formats of RIFF files, as media tools print them (fixed values).
SOUNDS = {1: "pcm", 3: "pcm_float", 6: "pcm_alaw", 7: "pcm_mulaw", 0x55: "mp3", 0xFF: "aac"}


@dataclass
class Head:
    """What a container's headers tell; offsets and sizes are those of its pictures."""

    container: str
    duration: float | None = None
    fps: float | None = None
    frame_count: int | None = None
    width: int | None = None
    height: int | None = None
    video_codec: str | None = None
    has_audio: bool = False
    audio_codec: str | None = None
    audio_rate: float | None = None
    channels: int | None = None
    depth: int = 0
    flipped: bool = False
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))


def _take(f, at: int, n: int) -> bytes:
    f.seek(at)
    got = f.read(n)
    if len(got) < n:
        raise ValueError(f"file ends within {n} bytes at {at}")
    return got


def riff_chunks(f, at: int, end: int) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(id, list kind, start, end) of the chunks between two places; a chunk that the file cuts short ends with it."""
    while at + 8 <= end:
        name, size = struct.unpack("<4sI", _take(f, at, 8))
        kind = _take(f, at + 8, 4) if name in (b"RIFF", b"LIST") and at + 12 <= end else b""
        yield name, kind, at + 8 + len(kind), min(end, at + 8 + size)
        at += 8 + size + size % 2


def boxes(f, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the boxes between two places."""
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", _take(f, at, 8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", _take(f, at + 8, 8))[0], 16
        elif size == 0:
            size = end - at
        if size < head:
            raise ValueError(f"box of {size} bytes at {at}")
        yield kind, at + head, min(end, at + size)
        at += size


def _sound(head: Head, form: bytes) -> int:
    """Takes a WAVEFORMAT into the head; bytes a second."""
    tag, channels, rate, per_second = struct.unpack("<HHII", form[:12])
    head.has_audio, head.audio_codec, head.audio_rate, head.channels = True, SOUNDS.get(tag, f"0x{tag:x}"), float(rate), channels
    return per_second


def _wave(f, start: int, end: int) -> Head:
    head, per_second = Head("wav"), 0
    for name, _, a, b in riff_chunks(f, start, end):
        if name == b"fmt ":
            per_second = _sound(head, _take(f, a, b - a))
        elif name == b"data" and per_second:
            head.duration = (b - a) / per_second
    return head


def _pictures(f, start: int, end: int, stream: int) -> Iterator[tuple[int, int]]:
    """(offset, size) of a stream's pictures, from the chunks themselves."""
    own = (b"%02ddb" % stream, b"%02ddc" % stream)
    for name, kind, a, b in riff_chunks(f, start, end):
        if name in own:
            yield a, b - a
        elif kind == b"rec ":
            yield from _pictures(f, a, b, stream)


def _segments(f, size: int) -> list[tuple[int, int]]:
    """Where the pictures of an AVI file lie: the lists of its first and of its further segments."""
    return [(c, d) for _, kind, a, b in riff_chunks(f, 0, size) if kind in (b"AVI ", b"AVIX") for _, k, c, d in riff_chunks(f, a, b) if k == b"movi"]


def _avi(f, start: int, end: int, size: int, offsets: bool) -> Head:
    head, stream, seen, table = Head("avi"), None, 0, None
    for name, kind, a, b in riff_chunks(f, start, end):
        if kind == b"hdrl":
            for n, k, c, d in riff_chunks(f, a, b):
                if n == b"avih":
                    micro, count, width, height = (struct.unpack("<14I", _take(f, c, 56))[i] for i in (0, 4, 8, 9))
                    head.fps, head.frame_count, head.width, head.height = (1e6 / micro if micro else None), count, width, height
                elif k == b"strl":
                    own = {x: (p, q) for x, _, p, q in riff_chunks(f, c, d)}
                    told, form = _take(f, own[b"strh"][0], 48), _take(f, own[b"strf"][0], own[b"strf"][1] - own[b"strf"][0])
                    scale, rate, _, length = struct.unpack("<4I", told[20:36])
                    if told[:4] == b"vids" and stream is None:
                        stream, head.flipped = seen, struct.unpack("<i", form[8:12])[0] > 0
                        head.depth, code = struct.unpack("<H4s", form[14:20])
                        head.video_codec = "rawvideo" if code == bytes(4) else code.decode("latin-1").strip("\0 ")
                        head.fps, head.frame_count = (rate / scale if scale and rate else head.fps), length or head.frame_count
                    elif told[:4] == b"auds" and not head.has_audio:
                        _sound(head, form)
                    seen += 1
        elif name == b"idx1":
            table = (a, b)
    if head.fps and head.frame_count:
        head.duration = head.frame_count / head.fps
    if offsets and stream is not None:
        lists = _segments(f, size)
        if table and len(lists) == 1:
            rows = np.frombuffer(_take(f, table[0], (table[1] - table[0]) // 16 * 16), np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
            rows = rows[np.isin(rows["id"], [b"%02ddb" % stream, b"%02ddc" % stream])]
            at = rows["at"].astype(np.int64) + 8
            # Places count from the file's start or from the list's kind; the first one tells.
            first = lists[0][0] - 4
            if len(at) and _take(f, int(at[0]) - 8, 4) != rows["id"][0]:
                at += first
            head.offsets, head.sizes = at, rows["size"].astype(np.int64)
        else:
            found = np.array([x for a, b in lists for x in _pictures(f, a, b, stream)], np.int64).reshape(-1, 2)
            head.offsets, head.sizes = found[:, 0], found[:, 1]
    return head


def _numbers(raw: bytes, width: int, at: int = 8) -> np.ndarray:
    """Big-endian numbers of a table box after its flags and count."""
    n = struct.unpack(">I", raw[at - 4 : at])[0]
    return np.frombuffer(raw[at : at + n * width], f">u{width if width < 8 else 8}").astype(np.int64)


def _sample_places(table: dict[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sizes of a track's samples, from its chunk and size tables."""
    fixed, count = struct.unpack(">II", table[b"stsz"][4:12])
    sizes = np.full(count, fixed, np.int64) if fixed else np.frombuffer(table[b"stsz"][12 : 12 + 4 * count], ">u4").astype(np.int64)
    chunks = _numbers(table[b"co64"], 8) if b"co64" in table else _numbers(table[b"stco"], 4)
    runs = np.frombuffer(table[b"stsc"][8:], ">u4").astype(np.int64).reshape(-1, 3)
    each = np.repeat(runs[:, 1], np.diff(np.r_[runs[:, 0], len(chunks) + 1]))
    chunk = np.repeat(np.arange(len(chunks)), each)[:count]
    before = np.cumsum(sizes) - sizes
    first = np.searchsorted(chunk, chunk, side="left")
    return chunks[chunk] + before - before[first], sizes


def _track(f, head: Head, start: int, end: int, offsets: bool) -> None:
    """Takes a track of sound or pictures into the head."""
    parts: dict[bytes, tuple[int, int]] = {}
    todo = [(start, end)]
    while todo:
        for kind, a, b in boxes(f, *todo.pop()):
            if kind in (b"mdia", b"minf", b"stbl"):
                todo.append((a, b))
            else:
                parts[kind] = (a, b)
    raw = lambda k: _take(f, parts[k][0], parts[k][1] - parts[k][0])
    kind = raw(b"hdlr")[8:12]
    media = raw(b"mdhd")
    scale, length = struct.unpack(">IQ", media[20:32]) if media[0] else struct.unpack(">II", media[12:20])
    entry = raw(b"stsd")[8:]
    code = entry[4:8].decode("latin-1").strip()
    if kind == b"soun" and not head.has_audio:
        channels, _, _, _, rate = struct.unpack(">HHHHI", entry[24:36])
        head.has_audio, head.audio_codec, head.channels, head.audio_rate = True, code, channels, rate / 65536.0
    elif kind == b"vide" and head.video_codec is None:
        head.video_codec = "rawvideo" if code == "raw" else code
        head.width, head.height = struct.unpack(">HH", entry[32:36])
        head.depth = struct.unpack(">H", entry[82:84])[0]
        head.depth = 8 if head.depth == 40 else head.depth  # 40: eight bits of grey
        head.frame_count = struct.unpack(">I", raw(b"stsz")[8:12])[0]
        seconds = length / scale if scale else 0.0
        head.fps = head.frame_count / seconds if seconds and head.frame_count else None
        if offsets:
            head.offsets, head.sizes = _sample_places({k: raw(k) for k in (b"stsz", b"stsc", b"stco", b"co64") if k in parts})


def _movie(f, size: int, offsets: bool) -> Head:
    head = Head("mp4")
    for kind, a, b in boxes(f, 0, size):
        if kind == b"moov":
            for k, c, d in boxes(f, a, b):
                if k == b"mvhd":
                    raw = _take(f, c, d - c)
                    scale, length = struct.unpack(">IQ", raw[20:32]) if raw[0] else struct.unpack(">II", raw[12:20])
                    head.duration = length / scale if scale else None
                elif k == b"trak":
                    _track(f, head, c, d, offsets)
    return head


def head_of(f, offsets: bool = False) -> Head:
    """The head of an opened file; with offsets, where its pictures lie."""
    size = f.size()
    first = _take(f, 0, 12)
    if first[:4] == b"RIFF":
        end = min(size, 8 + struct.unpack("<I", first[4:8])[0])
        return _wave(f, 12, end) if first[8:] == b"WAVE" else _avi(f, 12, end, size, offsets)
    if first[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free"):
        return _movie(f, size, offsets)
    raise ValueError("neither RIFF nor ISO base media")


def picture(raw: bytes, width: int, height: int, depth: int, flipped: bool) -> bytes:
    """Rows from the top, without padding; bottom-up pictures have rows padded to four bytes."""
    wide = width * depth // 8
    step = -(-wide // 4) * 4 if len(raw) >= height * (-(-wide // 4) * 4) else wide
    rows = np.frombuffer(raw[: step * height], np.uint8).reshape(height, step)[:, :wide]
    return (rows[::-1] if flipped else rows).tobytes()


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _ByFile(DataSourceReader):
    def __init__(self, options: dict, rows) -> None:
        self.path, self.rows = options["path"], rows

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in store.listed(self.path, ENDINGS)]

    def read(self, partition: InputPartition | None) -> Iterator:
        # Spark asks once, for nothing, where there are no partitions.
        return iter(()) if partition is None else self.rows(partition.path)


PROBE = "path string, status string, container string, duration double, fps double, frame_count long, width int, height int, video_codec string, has_audio boolean, audio_codec string, audio_rate double, channels int, valid boolean, warning string"
INDEX = "path string, frame long, msec double, offset long, size int, width int, height int, depth int, flipped boolean"
FRAMES = "path string, frame long, msec double, width int, height int, depth int, pixels binary"


def probed(path: str) -> tuple:
    """The row of media_probe for a file; what cannot be read is a status and not an error."""
    names = [p.split()[0] for p in PROBE.split(", ")]
    try:
        with store.opened(path) as f:
            head = asdict(head_of(f))
    except (OSError, ValueError, KeyError, struct.error) as e:
        return (path, f"failed: {e}", *[None] * 7, False, *[None] * 3, False, "unreadable")
    counted = head["frame_count"] / head["fps"] if head["fps"] and head["frame_count"] else None
    head["duration"] = counted if counted else head["duration"]
    valid = head["duration"] is not None and head["duration"] > 0
    missing = [("audio_stream_missing", not head["has_audio"]), ("duration_missing", not valid), ("fps_zero_or_missing", not head["fps"]), ("frame_count_zero_or_missing", not head["frame_count"])]
    head |= {"path": path, "status": "ok", "valid": valid, "warning": ";".join(n for n, is_so in missing if is_so)}
    return tuple(head[n] for n in names)


def _indexed(path: str) -> Iterator[pa.RecordBatch]:
    names = [p.split()[0] for p in INDEX.split(", ")]
    with store.opened(path) as f:
        head = head_of(f, offsets=True)
    if head.video_codec != "rawvideo" or not len(head.offsets):
        return
    for at in range(0, len(head.offsets), 65536):
        own = head.offsets[at : at + 65536]
        frame = np.arange(at, at + len(own))
        same = lambda v, kind, n=len(own): pa.array([v] * n, kind)
        columns = [same(path, pa.string()), pa.array(frame), pa.array(frame * 1000.0 / head.fps if head.fps else [None] * len(own), pa.float64()), pa.array(own), pa.array(head.sizes[at : at + 65536], pa.int32())]
        columns += [same(v, pa.int32()) for v in (head.width, head.height, head.depth)] + [same(head.flipped, pa.bool_())]
        yield pa.record_batch(columns, names=names)


def _in_sequence(path: str) -> Iterator[tuple]:
    """The pictures one after the other; those of AVI files are found by their chunks, without the index."""
    with store.opened(path) as f:
        head = head_of(f, offsets=True)
        if head.video_codec != "rawvideo":
            return
        if head.container == "avi":
            stream = next(int(_take(f, int(o) - 8, 2)) for o in head.offsets[:1]) if len(head.offsets) else 0
            places = (x for a, b in _segments(f, f.size()) for x in list(_pictures(f, a, b, stream)))
        else:
            places = zip(head.offsets.tolist(), head.sizes.tolist(), strict=True)
        for k, (at, size) in enumerate(places):
            yield path, k, k * 1000.0 / head.fps if head.fps else None, head.width, head.height, head.depth, picture(_take(f, at, size), head.width, head.height, head.depth, head.flipped)


class MediaProbe(DataSource):
    """A row a media file below path: duration, rate, frames, size, sound, and what is missing."""

    @classmethod
    def name(cls) -> str:
        return "media_probe"

    def schema(self) -> str:
        return PROBE

    def reader(self, schema) -> DataSourceReader:
        return _ByFile(self.options, lambda path: iter([probed(path)]))


class FrameIndex(DataSource):
    """A row a frame of uncompressed video below path, with the byte range of its picture."""

    @classmethod
    def name(cls) -> str:
        return "frame_index"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema) -> DataSourceReader:
        return _ByFile(self.options, _indexed)


class Frames(DataSource):
    """The pictures of uncompressed video below path, file by file in sequence."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _ByFile(self.options, _in_sequence)


def load(spark: SparkSession, source: type[DataSource], path: str) -> DataFrame:
    """One of the sources above over a path. Files that are no media are no rows of an index."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load(path)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [p.split()[0] for p in FRAMES.split(", ")]
    path, f = None, None
    for batch in batches:
        rows, out, size = batch.to_pylist(), [], 0
        for r in rows:
            if r["path"] != path:
                if f is not None:
                    f.close()
                path, f = r["path"], store.opened(r["path"])
            out.append((*(r[n] for n in names[:-1]), picture(_take(f, r["offset"], r["size"]), r["width"], r["height"], r["depth"], r["flipped"])))
            size += r["size"]
            if size > BATCH:
                yield _rows(out, names, batch.schema)
                out, size = [], 0
        yield _rows(out, names, batch.schema)


def _rows(out: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    kinds = [schema.field(n).type for n in names[:-1]] + [pa.binary()]
    return pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)


def read_frames(index: DataFrame) -> DataFrame:
    """The pictures of rows of a frame index, each by its byte range, wherever its row is."""
    return index.select(*[p.split()[0] for p in INDEX.split(", ")]).sortWithinPartitions("path", "offset").mapInArrow(_ranges, FRAMES)


def seek_frames(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pictures of wanted (path, frame); a number beyond the last frame has none."""
    return read_frames(index.join(wanted.select("path", "frame").distinct(), ["path", "frame"], "left_semi"))


def seek_msec(index: DataFrame, probe: DataFrame, wanted: DataFrame, msec: str | Column = "msec") -> DataFrame:
    """Pictures nearest to wanted (path, msec), as (path, wanted_msec, frame, ..., pixels)."""
    at = F.col(msec) if isinstance(msec, str) else msec
    asked = wanted.select("path", at.alias("wanted_msec")).distinct().join(probe.where("fps > 0").select("path", "fps"), "path")
    asked = asked.select("path", "wanted_msec", scalar.frame_index(F.col("wanted_msec") / 1000.0, "fps").alias("frame"))
    return asked.join(seek_frames(index, asked), ["path", "frame"])


# Sinks: uncompressed files, one picture or sample after the other.


def _chunk(name: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _format(rate: int) -> bytes:
    return struct.pack("<HHIIHH", 1, 1, rate, rate * 2, 2, 16)


def wav_file(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono sound."""
    return _chunk(b"RIFF", b"WAVE", _chunk(b"fmt ", _format(rate)), _chunk(b"data", samples.astype("<i2").tobytes()))


def avi_file(frames: list[np.ndarray], fps: int, rate: int = 0, index: bool = True) -> bytes:
    """Grey pictures (height, width), bottom-up; rate: a silent track of that many samples a second."""
    height, width = frames[0].shape
    wide = -(-width // 4) * 4
    body = [np.pad(x.astype(np.uint8), ((0, 0), (0, wide - width)))[::-1].tobytes() for x in frames]
    head = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(frames), 0, 2 if rate else 1, 0, width, height, 0, 0, 0, 0)
    stream = lambda kind, scale, per, n: struct.pack("<4s4s10I4H", kind, bytes(4), 0, 0, 0, scale, per, 0, n, 0, 0, 0, 0, 0, 0, 0)
    grey = b"".join(struct.pack("4B", k, k, k, 0) for k in range(256))
    bitmap = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, bytes(4), wide * height, 0, 0, 256, 0) + grey
    lists = [_chunk(b"LIST", b"strl", _chunk(b"strh", stream(b"vids", 1, fps, len(frames))), _chunk(b"strf", bitmap))]
    if rate:
        lists.append(_chunk(b"LIST", b"strl", _chunk(b"strh", stream(b"auds", 2, 2 * rate, 0)), _chunk(b"strf", _format(rate))))
    movie, rows, at = [], [], 4
    for x in body:
        for name, part in ((b"00db", x), (b"01wb", bytes(2 * (rate // fps)))):
            if part:
                rows.append(struct.pack("<4sIII", name, 0x10, at, len(part)))
                movie.append(_chunk(name, part))
                at += len(movie[-1])
    return _chunk(b"RIFF", b"AVI ", _chunk(b"LIST", b"hdrl", _chunk(b"avih", head), *lists), _chunk(b"LIST", b"movi", *movie), *([_chunk(b"idx1", *rows)] if index else []))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def mp4_file(frames: list[np.ndarray], fps: int, rate: int = 0, chunk: int = 3) -> bytes:
    """Grey pictures (height, width), top-down, in chunks of that many; rate: a silent track beside."""
    height, width = frames[0].shape
    raw = [x.astype(np.uint8).tobytes() for x in frames]
    sound = bytes(2 * rate * len(frames) // fps)
    begin = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    at, starts = len(begin) + 8, []
    for k in range(0, len(raw), chunk):
        starts.append(at)
        at += sum(map(len, raw[k : k + chunk]))
    full = lambda kind, *parts: _box(kind, bytes(4), *parts)
    table = lambda kind, rows, form: full(kind, struct.pack(">I", len(rows)), *[struct.pack(form, *r) for r in rows])
    rest = len(raw) % chunk
    runs = [(1, chunk, 1)] * (len(raw) >= chunk) + [(len(starts), rest, 1)] * bool(rest)

    def track(kind: bytes, scale: int, length: int, entry: bytes, *tables: bytes) -> bytes:
        media = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, scale, length, 0, 0))
        return _box(b"trak", _box(b"mdia", media, full(b"hdlr", bytes(4), kind, bytes(13)), _box(b"minf", _box(b"stbl", full(b"stsd", struct.pack(">I", 1), entry), *tables))))

    seen = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", width, height, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">HH", 40, 0xFFFF))
    tracks = [track(b"vide", fps, len(raw), seen, table(b"stts", [(len(raw), 1)], ">II"), table(b"stsc", runs, ">III"), full(b"stsz", struct.pack(">II", 0, len(raw)), *[struct.pack(">I", len(x)) for x in raw]), table(b"stco", [(s,) for s in starts], ">I"))]
    if rate:
        heard = _box(b"sowt", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 16, 0, 0, rate << 16))
        n = len(sound) // 2
        tracks.append(track(b"soun", rate, n, heard, table(b"stts", [(n, 1)], ">II"), table(b"stsc", [(1, n, 1)], ">III"), full(b"stsz", struct.pack(">II", 2, n)), table(b"stco", [(at,)], ">I")))
    movie = full(b"mvhd", struct.pack(">IIII", 0, 0, fps, len(raw)), bytes(80))
    return begin + _box(b"mdat", *raw, sound) + _box(b"moov", movie, *tracks)
