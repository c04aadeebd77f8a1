"""Container, frame and workbook sources on hand-made files."""

from __future__ import annotations

import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import books, containers, store


def films(folder) -> dict[str, list[np.ndarray]]:
    rng = np.random.default_rng(1)
    made = {n: [rng.integers(0, 256, (5, 7), dtype=np.uint8) for _ in range(11)] for n in ("a.avi", "bare.avi", "m.mp4")}
    for name, frames in made.items():
        content = containers.mp4_file(frames, 10, 4000) if name == "m.mp4" else containers.avi_file(frames, 10, 4000 if name == "bare.avi" else 0, index=name == "a.avi")
        store.put(f"{folder}/deep/{name}", content)
    return made


def test_probe_and_frames_by_three_ways(spark, tmp_path):
    made = films(tmp_path)
    store.put(f"{tmp_path}/s.wav", containers.wav_file(np.zeros(2000), 4000))
    store.put(f"{tmp_path}/broken.avi", b"RIFFxx")
    store.put(f"{tmp_path}/text.mp4", b"no media at all, only words")
    store.put(f"{tmp_path}/other.txt", b"ignored")
    folder = f"file://{tmp_path}"
    probe = containers.load(spark, containers.MediaProbe, folder)
    got = {r.path.rsplit("/", 1)[1]: r for r in probe.collect()}
    assert set(got) == {*made, "s.wav", "broken.avi", "text.mp4"}
    for name in made:
        r = got[name]
        assert (r.status, r.duration, r.fps, r.frame_count, r.width, r.height, r.valid) == ("ok", pytest.approx(1.1), 10.0, 11, 7, 5, True)
    assert not got["a.avi"].has_audio and got["a.avi"].warning == "audio_stream_missing"
    assert got["bare.avi"].has_audio and got["m.mp4"].audio_rate == 4000.0 and got["s.wav"].duration == 0.5
    assert all(got[n].status.startswith("failed") and not got[n].valid for n in ("broken.avi", "text.mp4"))

    good = f"{folder}/deep"
    want = {(n, k): x.tobytes() for n, frames in made.items() for k, x in enumerate(frames)}
    pixels = lambda f: {(r.path.rsplit("/", 1)[1], r.frame): bytes(r.pixels) for r in f.collect()}
    index = containers.load(spark, containers.FrameIndex, good)
    assert pixels(containers.load(spark, containers.Frames, good)) == want
    assert pixels(containers.read_frames(index.repartition(5))) == want
    asked = index.select("path").distinct().withColumn("frame", F.explode(F.array(*[F.lit(k).cast("long") for k in (0, 7, 99)])))
    assert pixels(containers.seek_frames(index, asked)) == {k: v for k, v in want.items() if k[1] in (0, 7)}
    times = index.select("path").distinct().withColumn("msec", F.explode(F.array(F.lit(0.0), F.lit(640.0), F.lit(9000.0))))
    probe = containers.load(spark, containers.MediaProbe, good)
    assert pixels(containers.seek_msec(index, probe, times)) == {k: v for k, v in want.items() if k[1] in (0, 6)}


def test_index_of_chunks_and_of_the_list_agree():
    frames = [np.full((2, 3), k, np.uint8) for k in range(4)]
    heads = [containers.head_of(pa_file(containers.avi_file(frames, 5, 100, index=i)), offsets=True) for i in (True, False)]
    assert heads[0].offsets.tolist() == heads[1].offsets.tolist() and heads[0].sizes.tolist() == heads[1].sizes.tolist() == [8] * 4
    assert heads[0].flipped and heads[0].depth == 8


def test_places_from_the_start_of_the_file():
    frames = [np.full((2, 4), k, np.uint8) for k in range(3)]
    content = containers.avi_file(frames, 5)
    own = containers.head_of(pa_file(content), offsets=True)
    at = content.index(b"idx1") + 8
    rows = b"".join(struct.pack("<4sIII", b"00db", 16, int(o) - 8, 8) for o in own.offsets)
    moved = containers.head_of(pa_file(content[:at] + rows + content[at + len(rows) :]), offsets=True)
    assert moved.offsets.tolist() == own.offsets.tolist()


def test_long_boxes_and_open_ends():
    content = containers.mp4_file([np.zeros((2, 2), np.uint8)], 5)
    at = content.index(b"mdat") - 4
    size = struct.unpack(">I", content[at : at + 4])[0]
    long = content[:at] + struct.pack(">I4sQ", 1, b"mdat", size + 8) + content[at + 8 :]
    assert containers.head_of(pa_file(long)).frame_count == 1
    at = content.index(b"moov") - 4
    last = content[:at] + bytes(4) + content[at + 4 :]
    assert containers.head_of(pa_file(last)).frame_count == 1
    with pytest.raises(ValueError, match="box of"):
        containers.head_of(pa_file(content[:at] + struct.pack(">I", 3) + content[at + 4 :]))


def pa_file(content: bytes):
    import pyarrow as pa

    return pa.BufferReader(content)


def test_folder_without_files(spark, tmp_path):
    for kind in (containers.MediaProbe, containers.FrameIndex, containers.Frames):
        assert containers.load(spark, kind, f"file://{tmp_path}").count() == 0
    assert books.read_sheets(spark, f"file://{tmp_path}").count() == 0


def header_row(spark, *cells):
    frame = spark.createDataFrame([("p", "s", 0, 0, 1, list(cells))], books.SCHEMA)
    (r,) = books.headers(frame).collect()
    return r


def test_headers_by_meaning(spark):
    r = header_row(spark, " Video-ID ", "영상 제목", "AD start (min)", "AD start [sec]", "광고 종료", "갑작스런 전환", None, "note")
    assert r["columns"] == {"video_id": 0, "video_title": 1, "ad_start_min": 2, "ad_start_sec_part": 3, "ad_end_combined": 4, "is_abrupt_transition_ad": 5}
    assert r["score"] == 13 and r["ambiguous"] == ""
    r = header_row(spark, "video id", "Video No", "title", "video title", "ad start")
    assert r["columns"] == {"ad_start_combined": 4} and r["score"] == 3 and r["ambiguous"] == "video_id=0|1;video_title=2|3"
    r = header_row(spark, "video id title", "ad start min")
    assert r["columns"] == {"ad_start_min": 1} and r["score"] == 0 and r["ambiguous"] == "0:video id title=video_id|video_title"


def test_times(spark):
    cases = {"1:05": (65.0, None), "1:02:03.5": (3723.5, None), " 7 : 8": (7.0, "combined_numeric_assumed_seconds"), "3분 20초": (200.0, None), "2 MIN": (120.0, None), "45 Seconds": (45.0, None), "1,234.5": (1234.5, "combined_numeric_assumed_seconds"), "": (None, "blank_time"), "soon": (None, "unparseable_time"), "-9": (-9.0, "combined_numeric_assumed_seconds")}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    value, warning = books.combined_seconds(F.col("t"))
    assert {r.t: (r.v, r.w) for r in rows.select("t", value.alias("v"), warning.alias("w")).collect()} == cases


def test_clean_labels(spark, tmp_path):
    head = ["video id", "title", "ad start min", "ad start sec", "ad end", "abrupt"]
    rows = [["1", "one", 0, 70, "2:00", "yes"], [None, " ", None, None, "", None], ["2", "two", 1, 0, "0:59", "later"], ["", "three", 1, "x", "oops"], [4.0, "four", 1, 0, "1:02", "no"], [5.5, "five", 0, 0, "20:00", "unclear"]]
    content = books.book_file({"first": [(1, ["nothing here"]), (2, ["1"])], "labels": [(2, ["head line"]), (5, head)] + [(7 + k, r) for k, r in enumerate(rows)], "again": [(1, head)]})
    store.put(f"{tmp_path}/b.xlsx", content)
    sheets = books.read_sheets(spark, f"file://{tmp_path}")
    got = sorted(books.clean_labels(books.mapped_rows(sheets, books.main_sheets(books.headers(sheets)))).collect(), key=lambda r: r.row_number)
    told = [(r.sheet, r.row_number, r.ad_interval_id, r.video_id, r.start_sec, r.end_sec, r.is_abrupt, r.invalid_reason, r.warnings) for r in got]
    assert told == [
        ("labels", 7, "A001", "1", 70.0, 120.0, "yes", "", "start:second_part_gte_60"),
        ("labels", 9, "A002", "2", 60.0, 59.0, "not_reviewed", "ad_duration_sec_not_positive; ad_end_sec_not_greater_than_ad_start_sec", ""),
        ("labels", 10, "A003", "", None, None, "not_reviewed", "ad_end_sec_not_numeric; ad_start_sec_not_numeric; missing_video_id", "end:unparseable_time"),
        ("labels", 11, "A004", "4", 60.0, 62.0, "no", "", "duration_very_short_lt_3_sec"),
        ("labels", 12, "A005", "5.5", 0.0, 1200.0, "unclear", "", "duration_very_long_gt_600_sec"),
    ]


def test_large_sheets_stream_and_odd_books_read(spark, tmp_path):
    store.put(f"{tmp_path}/long.xlsx", books.book_file({"a": [(k, [f"t{k % 7}", k, k / 2, True, None, "<&>"]) for k in range(1, 10001)], "b": []}))
    rows = books.read_sheets(spark, f"file://{tmp_path}")
    assert rows.count() == 10000 and rows.where("position <> row_number - 1").count() == 0
    assert rows.where("row_number = 9").first().cells == ["t2", "9", "4.5", "True", None, "<&>"]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/x.xml", f'<worksheet xmlns="{books._MAIN[1:-1]}"><sheetData><row><c t="inlineStr"><is><t>in</t><t>line</t></is></c><c r="AB1"><v>1e3</v></c><c t="s"><v>7</v></c></row></sheetData></worksheet>')
    store.put(f"{tmp_path}/odd.xlsx", out.getvalue())
    (r,) = books.read_sheets(spark, f"file://{tmp_path}/odd.xlsx").collect()
    assert (r.sheet, r.row_number, len(r.cells), r.cells[0], r.cells[27], r.cells[28]) == ("x", 1, 29, "inline", "1000", None)
    assert [books.column_name(k) for k in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"] and books.column_number("AAA1") == 703
