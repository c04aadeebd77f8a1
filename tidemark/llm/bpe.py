"""Byte-level BPE by monoid tree reduction.

A text is halved recursively down to leaves, leaves are encoded, and neighbours are joined on
the way up. What a join re-encodes follows from what meets at the boundary:

- white space after another character starts a match whatever stands on either side, so the ids
  are put side by side;
- white space on both sides is one match (but for its last character, where another follows):
  the ids of the two stretches are joined as one piece;
- white space before another character gives that character its last one: the stretch is encoded
  without it, and a window from it on;
- within one long run of letters, digits or signs, a few ids on either side are encoded again as
  one piece, and the window grows until the ids at both of its ends are stable: a sequence of ids
  is the encoding of its bytes exactly if each two neighbours are the encoding of theirs, so
  that ids outside the window then provably stay;
- else a window grows on either side to the next place where a match surely starts.

No call of the library sees a stretch of white space longer than a leaf, on which its regular
expressions would run out of stack. Decoding concatenates the bytes of halves up the same tree.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters in a leaf at most; a text no longer than this is one leaf and has no joins.
LEAF = 4096
#: Characters of the first window on either side of a boundary.
WINDOW = 64
#: Ids of the first window on either side of a boundary within a run.
IDS = 8
#: Ids of the last such window; beyond it a repeating run is out of step and is encoded again.
MOST = 1024
_SLICE = 128
#: What the pattern takes for white space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters that are surely letters, digits and signs of the pattern.
_L, _N, _S = r"A-Za-z\u4e00-\u9fa5\u3041-\u3096\u30a1-\u30fa\uac00-\ud7a3", "0-9", r"!-/:-@\[-`{-~\u3001\u3002\uff0c"
_TURN = f"(?<=[{_L}])[{_N}{_S}]|(?<=[{_N}])[{_L}{_S}]"
#: Places where a match starts whatever stands on either side, and whose left side ends in no
#: white space; and places where one starts whatever stands to the left.
_BREAK = regex.compile(f"(?<=[^{_WHITE}])[{_WHITE}]|{_TURN}")
_START = regex.compile(f"(?r)(?:[{_WHITE}](?=[^{_WHITE}])|{_TURN})")
_RUNS = {"white": f"[{_WHITE}]+", "letters": r"\p{L}+", "digits": r"\p{N}+", "signs": rf"[^{_WHITE}\p{{L}}\p{{N}}\p{{C}}']+"}
_HEAD = {kind: regex.compile(run) for kind, run in _RUNS.items()}
_TAIL = {kind: regex.compile("(?r)" + run) for kind, run in _RUNS.items()}


@functools.cache
def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass
class Node:
    """An encoded stretch of text; joins of nodes form a monoid whose unit is the empty node."""

    text: str
    ids: list[int]


def _tail(kind: str, text: str) -> int:
    """Length of the run of that kind at the end of text."""
    found = _TAIL[kind].match(text)
    return len(found.group()) if found else 0


def _head(kind: str, text: str) -> int:
    """Length of the run of that kind at the start of text."""
    found = _HEAD[kind].match(text)
    return len(found.group()) if found else 0


def _last_start(text: str) -> int:
    """Start of the shortest grown window at the end of text that begins at a sure match start."""
    width = WINDOW
    while width < len(text):
        found = _START.search(text, len(text) - width)
        if found:
            return found.start()
        width *= 2
    return 0


def _first_break(text: str) -> int:
    """End of the shortest grown window at the start of text that ends at a sure match start."""
    width = WINDOW
    while width < len(text):
        found = _BREAK.search(text, 1, width)
        if found:
            return found.start()
        width *= 2
    return len(text)


def _ids_within(codec_: tiktoken.Encoding, ids: Iterable[int], size: int) -> int:
    """Number of the first ids whose bytes are size together."""
    count, length = 0, codec_.decode_single_token_bytes
    for i in ids:
        if size <= 0:
            break
        size -= len(length(i))
        count += 1
    return count


def _stable(codec_: tiktoken.Encoding, a: int, b: int) -> bool:
    """Whether two ids are the encoding of their bytes as one piece."""
    return codec_._encode_single_piece(codec_.decode_bytes([a, b])) == [a, b]


def _join_piece(codec_: tiktoken.Encoding, left: list[int], right: list[int], before: int, after: int) -> list[int] | None:
    """Ids of left and right, where the last bytes of left (before) and the first of right (after)
    are of one piece; None where no window of up to MOST ids a side is stable at its ends."""
    width = IDS
    while width <= MOST and width < len(left) and width < len(right):
        if len(codec_.decode_bytes(left[-width - 1 :])) > before or len(codec_.decode_bytes(right[: width + 1])) > after:
            return None
        window = codec_._encode_single_piece(codec_.decode_bytes(left[-width:] + right[:width]))
        if _stable(codec_, left[-width - 1], window[0]) and _stable(codec_, window[-1], right[width]):
            return left[:-width] + window + right[width:]
        width *= 2
    return None


def _join_white(codec_: tiktoken.Encoding, left: Node, right: Node, tail: int, head: int) -> list[int]:
    """White space on both sides: one piece, less the last character where another one follows."""
    run = left.text[-tail:].encode()
    inner = right.text[: head if head == len(right.text) else head - 1].encode()
    if not inner:
        return left.ids + right.ids
    ids = _join_piece(codec_, left.ids, right.ids, len(run), len(inner))
    if ids is None:
        a, b = _ids_within(codec_, reversed(left.ids), len(run)), _ids_within(codec_, right.ids, len(inner))
        ids = left.ids[: len(left.ids) - a] + codec_._encode_single_piece(run + inner) + right.ids[b:]
    return ids


def _join_run(codec_: tiktoken.Encoding, left: Node, right: Node) -> list[int] | None:
    """Within a run of letters, digits or signs; None where it is short or no window is stable."""
    for kind in ("letters", "digits", "signs"):
        tail, head = _tail(kind, left.text), _head(kind, right.text)
        if tail > max(3, WINDOW) and head > WINDOW:
            # A contraction may take the first two letters of the run on the left.
            return _join_piece(codec_, left.ids, right.ids, len(left.text[3 - tail :].encode()), len(right.text[:head].encode()))
    return None


def _join_window(codec_: tiktoken.Encoding, left: Node, right: Node) -> list[int]:
    """A window between sure match starts; left is no white space or a single one."""
    start, end = left.text[_last_start(left.text) :], right.text[: _first_break(right.text)]
    a, b = _ids_within(codec_, reversed(left.ids), len(start.encode())), _ids_within(codec_, right.ids, len(end.encode()))
    return left.ids[: len(left.ids) - a] + codec_.encode_ordinary(start + end) + right.ids[b:]


def join(codec_: tiktoken.Encoding, left: Node, right: Node) -> Node:
    """The encoding of left.text + right.text from those of its halves."""
    if not left.text or not right.text:
        return left if left.text else right
    tail, head = _tail("white", left.text), _head("white", right.text)
    if tail and head:
        ids = _join_white(codec_, left, right, tail, head)
    elif head:
        ids = left.ids + right.ids
    elif tail:
        run = left.text[len(left.text) - tail :]
        gone = _ids_within(codec_, reversed(left.ids), len(run.encode()))
        last = Node(run[-1], codec_._encode_single_piece(run[-1].encode()))
        inner = codec_._encode_single_piece(run[:-1].encode()) if tail > 1 else []
        ids = left.ids[: len(left.ids) - gone] + inner + _join_window(codec_, last, right)
    else:
        ids = _join_run(codec_, left, right)
        if ids is None:
            ids = _join_window(codec_, left, right)
    return Node(left.text + right.text, ids)


def encode(codec_: tiktoken.Encoding, text: str, leaf: int = LEAF) -> Node:
    if len(text) <= leaf:
        return Node(text, codec_.encode_ordinary(text))
    middle = len(text) // 2
    return join(codec_, encode(codec_, text[:middle], leaf), encode(codec_, text[middle:], leaf))


def decode(codec_: tiktoken.Encoding, ids: list[int], leaf: int = LEAF) -> bytes:
    if len(ids) <= leaf:
        return codec_.decode_bytes(ids)
    middle = len(ids) // 2
    return decode(codec_, ids[:middle], leaf) + decode(codec_, ids[middle:], leaf)


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids binary as little-endian unsigned 32 bit, n_tokens, decoded binary) per row;
    null text counts as empty, and each row is answered by itself."""
    return _mapped(docs, path, id_col, text_col, leaf, digests=False)


def encoding_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row.

    Null text counts as empty: no ids, and the digests of no bytes. A null id stays null, and
    each row is answered by itself, repeated or not; an empty table gives no rows. Stretches of
    any length, white space too, are encoded."""
    return _mapped(docs, path, id_col, text_col, leaf, digests=True)


def _mapped(docs: DataFrame, path: str | None, id_col: str, text_col: str, leaf: int, digests: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                counts, packed, plain = [], [], []
                for text in part.column(1).to_pylist():
                    ids = encode(own, text or "", leaf).ids
                    counts.append(len(ids))
                    raw, back = np.array(ids, dtype="<u4").tobytes(), decode(own, ids, leaf)
                    packed.append(hashlib.sha256(raw).hexdigest() if digests else raw)
                    plain.append(hashlib.sha256(back).hexdigest() if digests else back)
                kind = pa.string() if digests else pa.binary()
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(packed, kind), pa.array(plain, kind)], names=names)

    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
