"""Token-id output as Arrow IPC files of fixed-size-list batches.

Documents are range-partitioned and sorted by id; each task encodes its documents, appends the
end id, cuts the stream into sequences of one length and writes them as record batches of
`ids: fixed_size_list<uint>[length]` and `mask: fixed_size_list<bool>[length]`, beside a file
that says where each document starts. The buffers are uncompressed, so a memory map of a local
file gives any sequence and its mask without a copy; only the last sequence of a file is padded,
and its mask says how far.

File names carry the task attempt, and only files of attempts whose row reached the manifest
count, so a lost executor or a second attempt leaves no half file behind in the result. Files are
written through pyarrow's file systems below the shared folder of the session.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut, qualified, shared_dir

LENGTH = 2048
#: Sequences in a record batch.
BATCH = 256
END_ID = 1
_SLICE = 256
#: Distinct pieces whose ids a worker remembers; beyond it the memory starts anew.
MEMORY = 800_000
#: Words in one call of the library.
_LINE = 1024
# Fixed value: the splitting pattern of the tokenizer file.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same matches on lower-cased Latin-1 text: letters, contractions, single digits, the rest.
_LETTERS, _DIGITS, _SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_PIECE = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_DIGITS}]|(?:(?!'(?:s|t|re|ve|m|ll|d))[^{_SPACE}{_LETTERS}{_DIGITS}])[^{_SPACE}{_LETTERS}{_DIGITS}]*")


class PieceEncoder:
    """The tokenizers library behind a bounded memory of pieces.

    The tokenizer lower-cases, drops white space and encodes each match of its splitting pattern
    by itself. On text of Latin-1 characters, where normalisation only lower-cases, the same
    matches are found here and their ids remembered, new ones coming from the library; any other
    text, one that holds an added token's literal, and any tokenizer of another build goes to the
    library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        size = self._library.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        #: Whether an id ends a word, by which the ids of a line of words part.
        self._ends = np.array([(self._library.id_to_token(k) or "").endswith("</w>") for k in range(size)])
        self._known: dict[str, bytes] = {}
        build = json.loads(self._library.to_str())
        split = (build["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        kinds = [n["type"] for n in (build["normalizer"] or {}).get("normalizers", [])]
        #: Literals that the library takes whole before it splits; in any case, as some match lower-cased text.
        self._added = sorted({t["content"].lower() for t in build["added_tokens"]})
        self._by_piece = split == _SPLIT and kinds == ["NFC", "Replace", "Lowercase"]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        pieces = [self._pieces(t) if t else [] for t in texts]
        known = self._known
        if len(known) > MEMORY:
            known.clear()
        fresh = set(itertools.chain.from_iterable(p for p in pieces if p is not None)).difference(known)
        words = [p for p in fresh if p.isalpha()]
        for at in range(0, len(words), _LINE):
            self._words(words[at : at + _LINE])
        others = [p for p in fresh if p not in known]
        known.update(zip(others, self._whole(others), strict=True))
        rest = iter(self._whole([t for t, p in zip(texts, pieces, strict=True) if p is None]))
        return [next(rest) if p is None else b"".join(map(known.__getitem__, p)) for p in pieces]

    def _pieces(self, text: str) -> list[str] | None:
        if not self._by_piece:
            return None
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return None
        low = text.lower()
        if any(a in low for a in self._added):
            return None
        return _PIECE.findall(low)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(got.ids, dtype=self.dtype).tobytes() for got in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> None:
        """Encodes words as one line. Each gives one word end or more, so as many ends as words
        mean one each; a line that says otherwise is left to be encoded word by word."""
        ids = np.array(self._library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) == len(words) and ends[-1] == len(ids):
            raw, size = ids.tobytes(), self.dtype.itemsize
            cuts = [0, *(ends * size).tolist()]
            self._known.update(zip(words, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=True))


@functools.cache
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class _Writer:
    """One file of sequences and one of document places."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, length: int) -> None:
        self._fs, base = _open(folder)
        self._fs.create_dir(base, recursive=True)
        self.path, self.index = f"{base}/{name}.arrow", f"{base}/{name}.docs.arrow"
        self._length, self._dtype = length, dtype
        self.kind = pa.from_numpy_dtype(dtype)
        schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self._places = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self._sink, self._index_sink = self._fs.open_output_stream(self.path), self._fs.open_output_stream(self.index)
        self._out, self._index_out = pa.ipc.new_file(self._sink, schema), pa.ipc.new_file(self._index_sink, self._places)
        self._rest, self._held, self.total, self.docs = [], 0, 0, 0

    def add(self, ids: list[int | None], packed: list[bytes]) -> None:
        starts, counts = [], []
        for raw in packed:
            n = len(raw) // self._dtype.itemsize
            starts.append(self.total)
            counts.append(n)
            self.total += n
            self._held += n
            self._rest.append(raw)
        self.docs += len(ids)
        self._index_out.write_batch(pa.record_batch([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=self._places))
        if self._held >= self._length * BATCH:
            flat = np.frombuffer(b"".join(self._rest), dtype=self._dtype)
            step = self._length * BATCH  # every batch but the last is full, so a sequence's number tells its place
            whole = len(flat) // step * step
            for at in range(0, whole, step):
                self._write(flat[at : at + step], None)
            self._rest, self._held = [flat[whole:].tobytes()], len(flat) - whole

    def _write(self, flat: np.ndarray, used: int | None) -> None:
        mask = np.ones(len(flat), dtype=bool)
        if used is not None:
            mask[used:] = False
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self._length) for x in (flat, mask)]
        self._out.write_batch(pa.record_batch(lists, names=["ids", "mask"]))

    def close(self) -> None:
        flat = np.frombuffer(b"".join(self._rest), dtype=self._dtype)
        if len(flat):
            padded = np.zeros(-(-len(flat) // self._length) * self._length, dtype=self._dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        for x in (self._out, self._sink, self._index_out, self._index_sink):
            x.close()


def write_tokens(
    docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, length: int = LENGTH, parts: int | None = None
) -> DataFrame:
    """Writes the files below folder (a URI) and returns their manifest: part, name, n_docs,
    n_tokens, one row a file, in the order of the stream by part.

    Order is ascending id, null first; rows of one id follow by a hash of their text, and each
    row is written. Null text gives the end id alone. An empty table gives no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path or public_tokenizers.path("word_bpe_49k.json"))
        end = np.array([end_id], dtype=own.dtype).tobytes()
        task, writer = TaskContext.get(), None
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                writer = writer or _Writer(folder, f"part-{task.partitionId():06d}-{task.taskAttemptId()}", own.dtype, length)
                writer.add(part.column(0).to_pylist(), [x + end for x in own.encode(part.column(1).to_pylist())])
        if writer:
            writer.close()
            name = writer.path.rsplit("/", 1)[1].removesuffix(".arrow")
            yield pa.record_batch([pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([writer.docs], pa.int64()), pa.array([writer.total], pa.int64())], names=["part", "name", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    keys = (F.col("doc_id").asc_nulls_first(), F.col("h").asc())
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    ordered = dealt.sortWithinPartitions(*keys).select("doc_id", "text")
    return cut(ordered.mapInArrow(run, "part int, name string, n_docs long, n_tokens long"))


def _read(folder: str, name: str) -> tuple[Iterator[tuple[pa.RecordBatch, pa.RecordBatch | None]], pa.RecordBatchFileReader]:
    store, base = _open(folder)
    opened = [pa.memory_map(f"{base}/{name}{x}") if isinstance(store, fs.LocalFileSystem) else store.open_input_file(f"{base}/{name}{x}") for x in (".arrow", ".docs.arrow")]
    return pa.ipc.open_file(opened[0]), pa.ipc.open_file(opened[1])


def sequence(folder: str, name: str, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number at of a file and its mask: random access without reading the rest."""
    tokens, _ = _read(folder, name)
    length = tokens.schema.field("ids").type.list_size
    batch = tokens.get_batch(at // BATCH)
    row = at % BATCH
    ids, mask = batch.column(0), batch.column(1)
    return ids.flatten()[row * length : (row + 1) * length].to_numpy(), mask.flatten()[row * length : (row + 1) * length].to_numpy(zero_copy_only=False)


def documents_of(folder: str, name: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the file, ids) of a file's documents, batch by batch."""
    tokens, places = _read(folder, name)
    wanted = ((i.as_py(), s.as_py(), n.as_py()) for k in range(places.num_record_batches) for b in [places.get_batch(k)] for i, s, n in zip(*b.columns, strict=True))
    held, begin, k = np.empty(0, np.uint32), 0, 0
    for doc, start, n in wanted:
        more = [held[start - begin :]]
        have = len(more[0])
        while have < n:
            batch = tokens.get_batch(k)
            k += 1
            flat = batch.column(0).flatten().to_numpy()
            if k == tokens.num_record_batches:
                flat = flat[batch.column(1).flatten().to_numpy(zero_copy_only=False)]
            more.append(flat)
            have += len(flat)
        held, begin = np.concatenate(more) if len(more) > 1 else more[0], start
        if len(held) < n:
            raise ValueError(f"{name} ends within document {doc}")
        yield doc, start, held[:n]


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files.

    The manifest has one row a file, a few bytes each; their running total is the only thing that
    passes through the driver.
    """
    files = [(r["name"], r["n_tokens"]) for r in manifest.orderBy("part").collect()]
    before = dict(zip([f for f, _ in files], itertools.accumulate([n for _, n in files], initial=0), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                for doc, start, ids in documents_of(folder, name):
                    out.append((doc, offset + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 8192:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    rows = [(n, before[n]) for n, _ in files]
    listed = spark.createDataFrame(rows, "name string, offset long")
    return listed.repartition(max(1, len(rows))).mapInArrow(run, schema)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [()] * 4
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_places(docs: DataFrame, path: str | None = None, folder: str | None = None, **options) -> DataFrame:
    """Writes all documents below a fresh folder of the shared one and reads them back."""
    spark = docs.sparkSession
    folder = qualified(spark, folder or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}")
    return read_documents(spark, folder, write_tokens(docs, folder, path, **options))
