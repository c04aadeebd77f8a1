"""SimHash near-dedup by anchor-point covering.

Two 64-bit fingerprints at distance 3 or less differ in at most one bit on one of their two
32-bit halves. On 31 bits of a half the Hamming [31, 26] code is a covering code of radius 1: the
word of one fingerprint has a code word (its anchor) within 1, and the word of the other lies
within 1 + 1 of that same anchor. So every fingerprint is copied to all anchors of both halves
within covering radius plus threshold (1 to 16 a half), and only fingerprints that meet at an
anchor are compared, over all 64 bits. Each anchor emits a star per group it finds rather than
its pairs, and components of the stars are the groups.

Equal fingerprints are one row before anchors are looked up. Anchors with more than HOT
fingerprints are cut into blocks whose pairs are compared in separate tasks.

The bits of an anchor are fixed (26 of 31), so the comparisons at an anchor grow with the square
of the table; at ten thousand million fingerprints an anchor holds some two thousand.

Near copies of five-word similarity NEAR (without_near_copies) differ in up to 14 of the 64 bits
above, which no anchors cover selectively. A few changed words change far fewer of the distinct
words than of the shingles, so the filter takes WORD_PRINTS fingerprints over the distinct words,
each bit a vote of them, looks each up by the same anchors, and lets pairs meet that share an
anchor and differ there in WORD_BITS bits at most. Texts of one template meet like that too, so
nothing is closed over yet: what met at an anchor is compared again by sketches of SKETCH bits,
each a bit of a minimum over the shingles. Groups of texts whose sketches agree are compared
exactly by their shingles, through an index of the shingles and not by pairs, and only exact links
connect texts. Large groups are compared by pairs of blocks at each step.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import row_hash
from tidemark.operators.graph import connected_components
from tidemark.session import cut

THRESHOLD = 3
SHINGLE = 3
SEED = 42
#: Most fingerprints that one task compares at one anchor.
HOT = 16384
#: Fingerprints over distinct words (an even number), and bits in which those that meet may differ.
WORD_PRINTS, WORD_BITS = 8, 8
#: Bits of a text's sketch, and in how many near copies differ: a tenth at similarity 0.8, and three
#: standard deviations more.
SKETCH, SKETCH_BITS = 512, 72
#: Words of a shingle and Jaccard similarity of near copies.
NEAR_WIDTH, NEAR = 5, 0.8
#: Texts and bytes of text that one task compares exactly.
BLOCK, BLOCK_BYTES = 1024, 32 << 20
#: Bytes of the candidates' names up to which they are broadcast.
SMALL = 8 << 20
_SLICE = 256


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int) -> Iterator[bytes]:
    """Space-joined runs of width words, repeats included; fewer words are one run, none is none."""
    if len(words) < width:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned SimHash of whole text: a bit is set where over half the shingle hashes set it."""
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles(_words(text), width)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


@functools.lru_cache(maxsize=1 << 17)
def _word_hash(word: bytes) -> bytes:
    return b"".join(xxhash.xxh3_128_digest(word, seed) for seed in range(WORD_PRINTS // 2))


def word_prints(text: str | None) -> np.ndarray:
    """WORD_PRINTS SimHashes of the distinct words of a whole text."""
    words = set(_words(text))
    ones = np.zeros(64 * WORD_PRINTS, dtype=np.int64)
    for part in itertools.batched(words, 4096):
        raw = b"".join(_word_hash(w) if len(w) <= 64 else _word_hash(xxhash.xxh3_128_digest(w)) for w in part)
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8 * WORD_PRINTS), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits((ones * 2 > len(words)).astype(np.uint8), bitorder="little").view("<i8")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the fingerprint in the place of the text, which is the last column."""
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            part = batch.slice(at, _SLICE)
            fp = np.fromiter((fingerprint(t) for t in part.columns[-1].to_pylist()), dtype=np.uint64, count=part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fp.view(np.int64))], names=[*part.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


_MASKS = np.array([sum(1 << i for i in range(31) if (i + 1) >> k & 1) for k in range(5)], dtype=np.uint32)
_LOW31 = np.uint32((1 << 31) - 1)
#: For each syndrome s > 0: the words that turn a word into its code words at distance 1 and 2.
_FLIPS = np.zeros((32, 16), dtype=np.uint32)
for _s in range(1, 32):
    _pairs = [(i, i ^ _s) for i in range(1, 32) if i < i ^ _s and i ^ _s]
    _FLIPS[_s] = [1 << (_s - 1), *((1 << (i - 1)) | (1 << (j - 1)) for i, j in _pairs)]


def anchors_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) pairs: all code words within distance 2 of each 31-bit word."""
    words = words.astype(np.uint32) & _LOW31
    syndrome = np.zeros(len(words), dtype=np.int64)
    for k in range(5):
        syndrome |= (np.bitwise_count(words & _MASKS[k]) & 1).astype(np.int64) << k
    found = words[:, None] ^ _FLIPS[syndrome]
    keep = np.ones(found.shape, dtype=bool)
    keep[syndrome == 0, 1:] = False
    return np.nonzero(keep)[0], found[keep]


def _cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (cell, fp, and the row's name where it has one) of fingerprints; a fingerprint of a
    set k is copied to the anchors of that set."""
    for frame in frames:
        fp = frame["fp"].to_numpy(np.int64)
        bits = fp.view(np.uint64)
        sets = frame["k"].to_numpy(np.int64) << np.int64(32) if "k" in frame else np.zeros(len(fp), np.int64)
        for half in (0, 1):
            row, anchor = anchors_of((bits >> np.uint64(32 * half)).astype(np.uint32))
            out = {"cell": anchor.astype(np.int64) | np.int64(half << 31) | sets[row], "fp": fp[row]}
            if "name" in frame:
                out["name"] = frame["name"].to_numpy(np.int64)[row]
            yield pd.DataFrame(out)


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows of words differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _stars(fp: np.ndarray, threshold: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges, as places, that join what is linked within one group: a search that compares each
    reached fingerprint only with those not reached yet."""
    left, right, rest = [], [], np.arange(len(fp))
    while len(rest) > 1:
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            far = _gap(fp[rest], fp[queue.pop()]) > threshold
            if not far.all():
                near = rest[~far]
                left.append(near)
                right.append(np.full(len(near), root))
                queue.extend(near)
                rest = rest[far]
    return left, right


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest place linked with each of n places, through any of the edges."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for at in (a, b, root[a], root[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(cell: np.ndarray, fp: np.ndarray, name: np.ndarray, threshold: int) -> pd.DataFrame:
    """Within each run of equal cells, an edge from each linked row to the smallest name that it
    is linked with there, through any links: cells that hold the same rows give the same edges.
    A fingerprint is a row of 64-bit words."""
    order = np.lexsort((name, cell))
    cell, fp, name = cell[order], fp[order], name[order]
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for start, size in zip(starts[sizes > 24], sizes[sizes > 24], strict=True):
        a, b = _stars(fp[start : start + size], threshold)
        left += [start + x for x in a]
        right += [start + x for x in b]
    small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 24), sizes))
    near_cell, near_fp = cell[small], fp[small]
    for shift in range(1, 24):
        if shift >= len(small):
            break
        same = np.flatnonzero(near_cell[shift:] == near_cell[:-shift])
        if not len(same):
            break
        near = same[_gap(near_fp[same], near_fp[same + shift]) <= threshold]
        left.append(small[near])
        right.append(small[near + shift])
    a, b = np.concatenate(left), np.concatenate(right)
    linked = np.unique(np.r_[a, b])
    root = _roots(np.searchsorted(linked, a), np.searchsorted(linked, b), len(linked))
    src, dst = name[linked], name[linked[root]]
    keep = src != dst
    return pd.DataFrame({"src": src[keep], "dst": dst[keep]}).drop_duplicates()


def _words_of(frame: pd.DataFrame) -> np.ndarray:
    """Fingerprints of a column fp of longs, or of packed words."""
    if frame["fp"].dtype == object:
        return np.frombuffer(b"".join(frame["fp"]), "<u8").reshape(len(frame), -1)
    return frame["fp"].to_numpy(np.int64).view(np.uint64).reshape(-1, 1)


def _link(threshold: int):
    """Streams rows sorted by cell; the last group of a batch waits for the next batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, fp, name = np.empty(0, np.int64), None, np.empty(0, np.int64)
        for frame in frames:
            if not len(frame):
                continue
            cell = np.r_[cell, frame["cell"].to_numpy(np.int64)]
            fp = _words_of(frame) if fp is None else np.concatenate([fp, _words_of(frame)])
            name = np.r_[name, frame["name" if "name" in frame else "fp"].to_numpy(np.int64)]
            done = int(np.searchsorted(cell, cell[-1]))
            if done:
                yield _compare(cell[:done], fp[:done], name[:done], threshold)
                cell, fp, name = cell[done:], fp[done:], name[done:]
        if len(cell):
            yield _compare(cell, fp, name, threshold)

    return run


def _met(cells: DataFrame, hot: int, threshold: int) -> DataFrame:
    """(src, dst) edges within the cells of rows (cell, fp) or (cell, fp, name): each linked row to
    the smallest it is linked with there. Cells of more than hot rows go by pairs of blocks."""
    compare = _link(threshold)
    carried = [c for c in cells.columns if c != "cell"]
    crowded = cut(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > hot))
    if crowded.isEmpty():
        return cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(compare, "src long, dst long")
    usual = cells.join(crowded, "cell", "left_anti").repartition("cell")
    found = usual.sortWithinPartitions("cell").mapInPandas(compare, "src long, dst long")
    blocks = F.ceil(F.col("n") * 2 / hot).cast("int")
    own = F.pmod(F.xxhash64(carried[-1]), blocks.cast("long")).cast("int")
    pairs = (
        cells.join(crowded, "cell")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), *carried)
    )
    return found.unionByName(pairs.repartition("cell").sortWithinPartitions("cell").mapInPandas(compare, "src long, dst long"))


def links(distinct: DataFrame, hot: int = HOT, threshold: int = THRESHOLD) -> DataFrame:
    """(src, dst) edges that connect all distinct fingerprints (fp) within the threshold of each
    other that meet at an anchor, which within THRESHOLD all do. Rows may carry a name, which
    edges then give in place of the fingerprint, and the number k of a set; sets do not mix."""
    columns = [c for c in ("k", "fp", "name") if c in distinct.columns]
    carried = [c for c in columns if c != "k"]
    cells = distinct.select(*columns).mapInPandas(_cells, "cell long, " + ", ".join(f"{c} long" for c in carried))
    return _met(cells, hot, threshold)


def _groups(marked: DataFrame) -> DataFrame:
    """(fp, component, component_id) of each fingerprint of rows (doc_id, fp): its group, named by
    the smallest fingerprint, and the group's smallest id."""
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = connected_components(links(distinct))
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp")
    heads = named.groupBy("component").agg(F.min("least").alias("head"))
    linked = cut(cut(named.select("fp", "component")).join(cut(heads), "component").select("fp", "component", "head"))
    return cut(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("head", "least").alias("component_id")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex), component_id (smallest reachable id).

    Null and empty texts have fingerprint zero and link like any other; a null id takes part in
    links and never names a component unless all its ids are null; repeated rows each get a row.
    An empty table gives no rows.
    """
    marked = cut(fingerprints(docs, id_col, text_col))
    return marked.join(_groups(marked), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _digest(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def _word_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the word fingerprints in the place of the text, which is the last column."""
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            part = batch.slice(at, _SLICE)
            prints = pa.array([word_prints(t) for t in part.columns[-1].to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], prints], names=[*part.schema.names[:-1], "prints"])


def _stars_of(edges: DataFrame) -> DataFrame:
    """(head, name) of the ends of edges (src, dst), each head among its own."""
    ends = F.explode(F.array("src", "dst")).alias("name")
    return edges.select(F.col("dst").alias("head"), ends).distinct()


def _meetings(marked: DataFrame, hot: int) -> DataFrame:
    """(head, name) of distinct texts of rows (_digest, prints) that met at anchors, gathered by the
    smallest of each meeting. A text is named by a hash of its digest. Texts that share a
    fingerprint meet by it, and the smallest of them alone goes to its anchors."""
    texts = cut(marked.groupBy("_digest").agg(F.first("prints").alias("prints")).select(F.xxhash64("_digest").alias("name"), F.posexplode("prints").alias("k", "fp")))
    sets = cut(texts.groupBy("k", "fp").agg(F.min("name").alias("name"), F.max("name").alias("other")))
    same = texts.join(sets.where("name <> other").select("k", "fp", F.col("name").alias("head")), ["k", "fp"]).select("head", "name")
    return cut(_stars_of(links(sets.select("k", "fp", "name"), hot, WORD_BITS)).unionByName(same).distinct())


_SEEDS = np.random.default_rng(SEED).integers(1, 1 << 63, (2, SKETCH), dtype=np.uint64) | np.uint64(1)


def sketch(hashes: np.ndarray) -> bytes:
    """SKETCH bits of a set of hashed shingles: the low bits of as many minima, each under a hash of
    its own. Two sets of similarity s agree in a bit with probability (1 + s) / 2; the empty set
    has no bit set."""
    if not len(hashes):
        return bytes(SKETCH // 8)
    low = np.full(SKETCH, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 512):
        mixed = (hashes[at : at + 512, None] ^ _SEEDS[0]) * _SEEDS[1]
        mixed ^= mixed >> np.uint64(32)
        np.minimum(low, mixed.min(axis=0), out=low)
    return np.packbits((low * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)).astype(np.uint8)).tobytes()


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the sketch and the distinct hashed shingles in the place of the text, which is the last column."""
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            part = batch.slice(at, _SLICE)
            sets = [np.fromiter({digest(s, SEED) for s in shingles(_words(t), NEAR_WIDTH)}, "<u8") for t in part.columns[-1].to_pylist()]
            columns = [*part.columns[:-1], pa.array([sketch(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], "sketch", "shingles"])


def near_edges(sets: list[np.ndarray], least: float = NEAR) -> Iterator[tuple[int, int]]:
    """(place, root) edges that join all sets linked through pairs of similarity least or more.
    Empty sets are equal. Shared shingles are counted through an index of all shingles; each set
    reached is compared with those not reached yet."""
    sizes = np.array([len(s) for s in sets])
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(place, kind="stable")]
    ends = np.cumsum(np.bincount(place, minlength=len(every)))
    begins = np.r_[0, ends[:-1]]
    bounds = np.r_[0, np.cumsum(sizes)]
    rest = np.ones(len(sets), bool)
    for root in range(len(sets)):
        if not rest[root]:
            continue
        rest[root] = False
        queue = [root]
        while queue and rest.any():
            now = queue.pop()
            own = place[bounds[now] : bounds[now + 1]]
            own = own[ends[own] - begins[own] > 1]
            held = [holders[begins[x] : ends[x]] for x in own]
            both = np.bincount(np.concatenate(held), minlength=len(sets)) if held else np.zeros(len(sets), np.int64)
            near = np.flatnonzero(rest & (both * (1 + least) >= least * (sizes[now] + sizes) - 1e-9))
            rest[near] = False
            queue.extend(near.tolist())
            yield from ((int(x), root) for x in near)


def _exact(frame: pd.DataFrame) -> pd.DataFrame:
    names = frame["_digest"].to_list()
    found = list(near_edges([np.frombuffer(s, "<u8") for s in frame["shingles"]]))
    return pd.DataFrame({"src": [names[a] for a, _ in found], "dst": [names[b] for _, b in found]}, columns=["src", "dst"])


def _near_texts(docs: DataFrame, marked: DataFrame, hot: int, block: int) -> DataFrame:
    """(node, component) of the digests of texts linked by the similarity of their shingles."""
    met = _meetings(marked, hot)
    wanted = cut(met.select("name").distinct())
    if wanted.count() * 64 <= SMALL:
        wanted = F.broadcast(wanted)
    texts = docs.select(_digest(F.col("text")).alias("_digest"), F.col("text").cast("string").alias("text")).withColumn("name", F.xxhash64("_digest"))
    found = texts.join(wanted, "name").groupBy("_digest", "name").agg(F.first("text").alias("text"))
    found = found.select("_digest", "name", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), "text")
    sets = cut(found.mapInArrow(_shingle_sets, "_digest binary, name long, bytes long, sketch binary, shingles binary"))
    # What met is compared by sketches; groups of what agrees, by all their shingles.
    sketched = cut(met.join(sets.select("name", F.col("sketch").alias("fp")), "name").select(F.col("head").alias("cell"), "fp", "name"))
    near = connected_components(_met(sketched, hot, SKETCH_BITS)).select(F.col("component").alias("head"), F.col("node").alias("name"))
    near = cut(near.join(sets.select("name", "bytes"), "name"))
    sizes = cut(near.groupBy("head").agg(F.count("*").alias("n"), F.sum("bytes").alias("all_bytes")))
    blocks = F.greatest(F.ceil(F.col("n") * 2 / block), F.ceil(F.col("all_bytes") * 2 / BLOCK_BYTES)).cast("int")
    whole = (F.col("n") <= block) & (F.col("all_bytes") <= BLOCK_BYTES)
    placed = cut(near.select("head", "name").join(sizes.select("head", F.when(whole, 1).otherwise(blocks).alias("blocks")), "head"))
    own = F.pmod(F.xxhash64("name"), F.col("blocks").cast("long")).cast("int")
    dealt = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 or own <> other")
    dealt = dealt.select("head", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "name").join(sets.select("name", "_digest", "shingles"), "name").drop("name")
    return connected_components(cut(dealt.groupBy("head", "lo", "hi").applyInPandas(_exact, "src binary, dst binary")))


def without_near_copies(docs: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """One row of each group of near copies, of the group's smallest id, columns unchanged.

    Two texts are near copies where their sets of five-word shingles (fewer words: the whole
    sequence) have a Jaccard similarity of 0.8 or more; groups are what such pairs connect. Every
    pair that is linked was compared exactly; which pairs are compared is left to the word
    fingerprints, whose measured recall the README gives.

    Null text counts as empty, and texts of no words are equal. A null id is a group's smallest
    only where all its ids are null. Groups that share their smallest id, null too, each keep a
    row of their own; among rows of that id in one group the text of the smallest digest stays,
    and its repeats stay once. An empty table gives no rows.

    Rows are found again by id and digest of the text; ids join as text, null as a word of its
    own, so that the join and the choice among repeated rows share one exchange of the documents."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id")
    digest = _digest(F.col("text")).alias("_digest")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest, F.col("text").cast("string").alias("text"))
    marked = cut(rows.mapInArrow(_word_prints, "doc_id long, _digest binary, prints array<long>"))
    near = cut(_near_texts(docs, marked, hot, block))
    grouped = marked.join(near.withColumnRenamed("node", "_digest"), "_digest", "left")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_digest")).alias("least")
    heads = grouped.groupBy(F.coalesce("component", "_digest")).agg(least).select("least.doc_id", "least._digest").select(name, "_digest")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), name, digest)
    kept = whole.join(heads, ["_id", "_digest"], "left_semi")
    once = Window.partitionBy("_id", "_digest").orderBy(row_hash(docs))
    return kept.withColumn("_n", F.row_number().over(once)).where("_n = 1").select("_row.*")
