"""Media sources. Decoders are registered by name and run on Arrow batches of (path, start, end)
rows; the engine itself takes samples, scores and texts as columns. A WAV decoder is built in;
frame grabbers, text readers and models belong to the site and register themselves."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

Decoder = Callable[[bytes, float, float], dict]
_DECODERS: dict[str, tuple[Decoder, str]] = {}


def register(name: str, schema: str, decoder: Decoder) -> None:
    """decoder(content, start, end) gives the columns of schema for one row."""
    _DECODERS[name] = (decoder, schema)


def backend(wanted: str = "auto", order: tuple[str, ...] = ("native", "wav")) -> str:
    """The wanted decoder, or with auto the first registered one in order, else none."""
    if wanted != "auto":
        if wanted not in _DECODERS:
            raise ValueError(f"no decoder {wanted}; there are {sorted(_DECODERS)}")
        return wanted
    return next((n for n in order if n in _DECODERS), "none")


def wav(content: bytes, start: float, end: float) -> dict:
    """Mono samples in [-1, 1] of a stretch of a WAV file, with rate and duration."""
    with wave.open(io.BytesIO(content)) as w:
        rate, width, channels, n = w.getframerate(), w.getsampwidth(), w.getnchannels(), w.getnframes()
        first, last = max(0, int(start * rate)), min(n, int(end * rate) if end > 0 else n)
        w.setpos(min(first, n))
        raw = w.readframes(max(0, last - first))
    kind = {1: np.uint8, 2: np.int16, 4: np.int32}[width]
    x = np.frombuffer(raw, kind).astype(np.float32).reshape(-1, channels).mean(axis=1)
    x = (x - 128) / 128 if width == 1 else x / float(2 ** (8 * width - 1))
    return {"rate": rate, "duration": n / rate if rate else 0.0, "samples": x.tolist()}


register("wav", "rate int, duration double, samples array<float>", wav)


def decode(spark: SparkSession, plan: DataFrame, files: str, name: str = "auto") -> DataFrame:
    """Rows of plan (path, start, end) with the decoder's columns and status; a row that cannot
    be decoded says so and holds nulls, and fails nothing else."""
    chosen = backend(name)
    if chosen == "none":
        raise ValueError("no decoder is registered")
    decoder, schema = _DECODERS[chosen]
    columns = [p.strip().split()[0] for p in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, start, end, content in zip(frame["path"], frame["start"], frame["end"], frame["content"], strict=True):
                try:
                    rows.append({"path": path, "start": start, "end": end, "status": "ok"} | decoder(content, start, end))
                except Exception as e:  # noqa: BLE001
                    rows.append({"path": path, "start": start, "end": end, "status": f"failed: {e}"} | dict.fromkeys(columns))
            yield pd.DataFrame(rows, columns=["path", "start", "end", "status", *columns])

    content = spark.read.format("binaryFile").load(files).select("path", "content")
    return plan.join(content, "path").select("path", "start", "end", "content").mapInPandas(run, f"path string, start double, end double, status string, {schema}")
