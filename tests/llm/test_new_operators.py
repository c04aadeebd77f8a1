"""Vector codes, the filter audit and sharding against plain versions, odd rows and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import filter_audit, sharding, vector_codes

# vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """{vec_id: (code, error)} and the digest, entry by entry."""
    ints = {i: [int(np.floor(4096.0 * float(x))) for x in v] for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    cut = {i: [v[p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)] for i, v in ints.items()}
    books = [[list(cut[i][p]) for i in sorted(cut)[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return {i: [min((gap(ps[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for i, ps in cut.items()}

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut[i][p] for i, a in found.items() if a[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: ("".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a)) for i, a in assign().items()}, digest


def vectors(spark, rows, kind="float", partitions=3):
    return spark.createDataFrame([(*r, 7) for r in rows], f"vec_id long, embedding array<{kind}>, label int, code int").repartition(partitions)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_codes_equal_the_plain_rounds(spark, kind):
    rng = random.Random(5)
    rows = [(k, [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5, rng.uniform(-1, 1)]) for _ in range(16)], rng.choice([None, 1, 2])) for k in range(120)]
    rows += [(200, None, 1), (201, [float("nan")] * 16, 1), (202, [None] + [0.1] * 15, 2), (203, [float("inf")] * 16, None)]
    want, digest = plain_codes(rows)
    if kind == "float":
        want, digest = plain_codes([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    got = vector_codes.code_report(vectors(spark, rows, kind)).collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == want and {r.codebooks_sha256 for r in got} == {digest}
    label = {i: lab for i, _, lab in rows}
    total = Counter()
    for i, (_, e) in want.items():
        total[label[i]] += e
    assert all(r.label_error == total[label[r.vec_id]] for r in got)


def test_ties_go_to_the_lower_index(spark):
    """Equal first vectors are equal entries, of which only the lowest moves."""
    rows = [(k, [0.5] * 8, 0) for k in range(20)] + [(k, [-0.5] * 8, 0) for k in range(20, 30)]
    got = {r.vec_id: r.code for r in vector_codes.code_report(vectors(spark, rows)).collect()}
    want, _ = plain_codes(rows)
    assert got == {i: c for i, (c, _) in want.items()}


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_tree_search_equals_a_scan_of_all_entries(data):
    width, n = data.draw(st.integers(1, 4)), data.draw(st.integers(1, 20))
    cell = st.lists(st.integers(-3, 3), min_size=width, max_size=width)
    book = np.array(data.draw(st.lists(cell, min_size=n, max_size=n)), np.int64)
    x = np.array(data.draw(st.lists(cell, min_size=1, max_size=30)), np.int64)
    index, distance = vector_codes.nearest(book, vector_codes.tree_of(book), x)
    gaps = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (index == gaps.argmin(axis=1)).all() and (distance == gaps.min(axis=1)).all()


def test_odd_vectors(spark):
    rows = [(None, [0.1] * 8, 1), (1, [0.2] * 8, None), (1, [0.2] * 8, None), (2, [], 1), (3, [0.5, 0.25, 1.0], 1), (4, [1e30] * 8, 2), (5, [-1e30] * 8, 2), (6, None, 3)]
    got = vector_codes.code_report(vectors(spark, rows, "double")).collect()
    assert len(got) == 7 and {r.vec_id for r in got} == {None, 1, 2, 3, 4, 5}
    assert all(re.fullmatch("([0-9a-f]{2}){8}", r.code) for r in got)
    assert len({r.codebooks_sha256 for r in got}) == 3  # one a length
    assert sum(r.vec_id == 1 for r in got) == 2 and {r.error for r in got} == {0}
    again = vector_codes.code_report(vectors(spark, rows, "double", 1)).collect()
    key = lambda r: (str(r.vec_id), r.code, r.error)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert vector_codes.code_report(vectors(spark, rows).limit(0)).count() == 0
    assert vector_codes.code_report(vectors(spark, rows).where("vec_id = 6")).count() == 0


def test_large_sums_stay_exact():
    book = np.zeros((1, 1, 1), np.int64)
    top = vector_codes.limit_of(1)
    assert (2 * top) ** 2 < 2**63
    index, distance = vector_codes.nearest(book[0], vector_codes.tree_of(book[0]), np.array([[top], [-top]]))
    assert index.tolist() == [0, 0] and distance.tolist() == [top * top] * 2


# filter audit


def plain_fails(rows):
    """{row number: letters that fail} of (doc_id, text) rows."""
    least: dict = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": re.search("[#$%&*|]", t) is not None,
            "E": i is not None and i > least[t],
        }
        out.append("".join(k for k in "ABCDE" if bad[k]))
    return out


def plain_audit(docs, labels):
    fails = plain_fails([(r["doc_id"], r["text"]) for r in docs])
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {r["lang"] or "" for r in docs}:
        own = [(f, r["doc_id"]) for f, r in zip(fails, docs, strict=True) if (r["lang"] or "") == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone = [d for d in left if k in d[0]]
                left = [d for d in left if k not in d[0]]
                shapley[k] += len(gone)
                here = sum(k in f for f, _ in own)
                out[part, "".join(order), step] = [len(left), len(gone), here - len(gone), sum(f == k for f, _ in own), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone), k]
        for key in [x for x in out if x[0] == part]:
            out[key][6] = shapley[out[key][6]]
    return out


def audit_rows(frame):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in frame.collect()}


def test_audit_of_odd_rows(spark, odd, empty):
    long = " ".join(f"w{k}" for k in range(120))
    more = [(20, long, "en"), (21, long, "de"), (21, long, "de"), (None, long, "en"), (22, long + " #", None), (23, long.upper(), ""), (24, " ".join(["a", "b"] * 80), "en"), (None, None, None), (25, long.upper() + " #", "en"), (26, long.upper() + " #", "en")]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True)
    marks = [(20, 1, 0), (21, 1, 1), (21, 0, 0), (24, None, 1), (None, 1, 1), (26, 1, 1), (9, 1, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rows = [r.asDict() for r in docs.collect()]
    got = audit_rows(filter_audit.filter_audit(docs, labels))
    assert got == plain_audit(rows, marks) and len(got) == 600 * len({r["lang"] or "" for r in rows})
    assert audit_rows(filter_audit.filter_audit(docs.repartition(5), labels)) == got
    assert filter_audit.filter_audit(empty, labels).count() == 0
    assert audit_rows(filter_audit.filter_audit(docs, labels.limit(0))).keys() == got.keys()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \t\n\x0b\x0c\r#|  \U0001f600\x00", max_size=40), max_size=6))
def test_scan_equals_the_patterns(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    seen = filter_audit.scanned(np.frombuffer(b"".join(raw), np.uint8), offsets)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert seen["words"].tolist() == [len(w) for w in words] and seen["distinct"].tolist() == [len(set(w)) for w in words]
    assert seen["capitals"].tolist() == [len(re.findall("[A-Z]", t)) for t in texts]
    assert seen["signs"].tolist() == [len(re.findall("[#|]", t)) for t in texts] and seen["points"].tolist() == [len(t) for t in texts]


def test_scan_by_blocks_and_words_of_one_hash(monkeypatch):
    texts = ["a b a", "", "x" * 5000 + " " + "x" * 4999 + "y " + "x" * 5000, "one two one two three"] * 3
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    whole = filter_audit.scanned(data, offsets)
    monkeypatch.setattr(filter_audit, "BLOCK", 7)
    small = filter_audit.scanned(data, offsets)
    assert all((whole[k] == small[k]).all() for k in whole) and whole["distinct"].tolist() == [2, 0, 2, 3] * 3
    monkeypatch.setattr(filter_audit, "word_hashes", lambda d, s, e: np.zeros(len(s), np.uint64))
    assert filter_audit.scanned(data, offsets)["distinct"].tolist() == [2, 0, 2, 3] * 3


# sharding


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=7), st.integers(1, 7), st.lists(st.integers(0, 30), min_size=7, max_size=7))
def test_transfers_move_the_fewest_bytes(sizes, n, held):
    old = dict(enumerate(sizes))
    room = sharding.capacities(sum(sizes), held[:n])
    assert sum(room) == sum(sizes) and min(room) >= 0
    level = [h + r for h, r in zip(held[:n], room, strict=True) if r]
    assert not level or max(level) - min(level) <= 1
    moves = sharding.transfers(old, room)
    assert {o: sum(x for _, x in p) for o, p in moves.items()} == old
    taken = Counter()
    for parts in moves.values():
        for j, x in parts:
            taken[j] += x
    assert all(taken[j] == r for j, r in enumerate(room))
    moved = sum(x for o, p in moves.items() for j, x in p if j != o)
    assert moved == sum(max(0, s - (room[o] if o < n else 0)) for o, s in old.items())
    assert all(j == o or k for o, p in moves.items() for k, (j, _) in enumerate(p)) or any(o >= n or not room[o] for o in old)


def test_flow_finds_the_cheapest_way():
    flow = sharding.Flow(4)
    dear, cheap, back = flow.edge(0, 1, 5, 4), flow.edge(0, 2, 3, 1), flow.edge(2, 1, 9, 1)
    out = flow.edge(1, 3, 6, 0)
    flow.solve(0, 3)
    assert [flow.sent(k) for k in (dear, cheap, back, out)] == [3, 3, 3, 6]


def held(layout):
    """{shard: (bytes, slots)} of a layout's rows."""
    out: dict = {}
    for r in layout.rows.select(F.col(layout.shard).alias("s"), F.col(layout.slot).alias("p"), sharding.row_bytes(F.col("text")).alias("b")).collect():
        have = out.setdefault(r.s, [0, []])
        have[0] += r.b
        have[1].append(r.p)
    return out


def test_shards_of_a_table(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k % 900 if k % 50 else None, "é" * rng.choice([1, 20, 400, rng.randint(0, 200)]) if k % 77 else None, k, "s") for k in range(3000)]
    rows += [(k, "x" * 30000, k, "s") for k in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int, slot string").repartition(6, "shard").write.parquet(str(tmp_path / "t"))
    layout = sharding.reshard(spark, str(tmp_path / "t"), 7)
    got = held(layout)
    assert sorted(got) == list(range(7)) and all(sorted(p) == list(range(len(p))) for _, p in got.values())
    size = [b for b, _ in got.values()]
    assert sum(size) == layout.total and max(size) - min(size) <= 2 * layout.total / 7 / sharding.FINE + 2
    assert layout.rows.columns[:4] == ["doc_id", "text", "shard", "slot"] and layout.shard == "shard_" and layout.slot == "slot_"
    whole = lambda f: sorted(map(str, f.select("doc_id", "text", "shard", "slot").collect()))
    assert whole(layout.rows) == whole(spark.read.parquet(str(tmp_path / "t")))
    assert sum(r.rows for r in layout.manifest.collect()) == 3004 and 0 < layout.moved < layout.total


def test_files_that_lose_nothing_are_not_written_again(spark, tmp_path):
    """Two old shards of the same bytes, dealt over as many: no row moves, no file is written."""
    path = str(tmp_path / "even")
    rows = [(k, "abcd", f"p{k % 8}") for k in range(4096)]
    spark.createDataFrame(rows, "doc_id long, text string, g string").repartitionByRange(8, "g").write.parquet(path)
    files = spark.read.parquet(path).select("_metadata.file_name").distinct().count()
    for n in (1, 3):
        layout = sharding.reshard(spark, path, n)
        kinds = Counter(r.file.split(":")[0] for r in layout.manifest.collect())
        assert kinds["old"] == files if n == 1 else kinds["old"] > 0 or layout.moved == layout.total
        assert (layout.moved == 0) == (n == 1)


def test_shard_report_of_odd_and_empty_tables(spark, odd, empty, tmp_path):
    odd.write.parquet(str(tmp_path / "odd"))
    empty.write.parquet(str(tmp_path / "empty"))
    got = sharding.shard_report(spark, str(tmp_path / "odd")).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert all(0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None for r in got)
    assert len({(r.shard, r.slot) for r in got}) == len(got)
    assert sharding.shard_report(spark, str(tmp_path / "empty")).count() == 0


def test_shards_of_the_documents_are_level(spark, small):
    rows = sharding.shard_report(spark, f"{small}/documents.parquet").collect()
    size: Counter = Counter()
    for r in rows:
        size[r.shard] += r["size"]
    largest, total = max(r["size"] for r in rows), sum(size.values())
    assert max(size.values()) <= max(largest, 1.05 * total / 40 + total / 40 / sharding.FINE * 2) + largest / 4
