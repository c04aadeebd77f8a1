"""Sharding by minimum-cost flow: a table's files are dealt anew so that all shards hold equal bytes.

The files of the table are its old shards' files (a file's name names its old shard). From the
bytes of the old shards and the capacities of the new ones a minimum-cost flow, in which a byte
that stays costs nothing and one that moves costs one, gives the transfers that move the fewest
bytes. An old shard's rows, in the order of their files and places, are cut where its transfers
end: a block of neighbouring rows goes to each receiver. Only files that lose rows are written
again, each task writing its own rows, with no shuffle of texts; all others stay as they are and
belong to the new layout by name.

Rows larger than a part in FINE of a shard would make the cuts uneven. As sizes add up to as many
shards, there are fewer than FINE such rows a shard at any size of the table: they are placed one
by one, the largest first, each in its own shard while it fits and else in the emptiest.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict, deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut, shared_dir

SHARDS = 40
#: Rows above a part in FINE of a shard are placed one by one.
FINE = 64
#: Rows of a chunk, whose bytes are summed before old shards are.
CHUNK = 8192
#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: Files of the new layout up to which their list is broadcast (about 100 bytes a file).
FILES = 200_000


class Flow:
    """Minimum-cost flow on a sparse graph: shortest paths by potentials, then all paths of that
    cost at once by blocking flows."""

    def __init__(self, nodes: int) -> None:
        self.edges: list[list[int]] = []  # to, room, cost; edge k ^ 1 is the reverse of edge k
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        self.out[a].append(len(self.edges))
        self.edges.append([b, room, cost])
        self.out[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def sent(self, k: int) -> int:
        return self.edges[k ^ 1][1]

    def solve(self, source: int, sink: int) -> None:
        price = [0] * len(self.out)
        while True:
            far = [None] * len(self.out)
            heap = [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if far[a] is not None:
                    continue
                far[a] = d
                for k in self.out[a]:
                    b, room, cost = self.edges[k]
                    if room and far[b] is None:
                        heapq.heappush(heap, (d + cost + price[a] - price[b], b))
            if far[sink] is None:
                return
            most = max(d for d in far if d is not None)
            price = [p + (most if d is None else d) for p, d in zip(price, far, strict=True)]
            while self._block(source, sink, price):
                pass

    def _block(self, source: int, sink: int, price: list[int]) -> bool:
        """One blocking flow over edges of no reduced cost; whether any flow went."""
        free = lambda a, k: self.edges[k][1] > 0 and self.edges[k][2] + price[a] == price[self.edges[k][0]]
        level, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for k in self.out[a]:
                if free(a, k) and self.edges[k][0] not in level:
                    level[self.edges[k][0]] = level[a] + 1
                    queue.append(self.edges[k][0])
        if sink not in level:
            return False
        at, path = defaultdict(int), []
        while True:
            a = self.edges[path[-1]][0] if path else source
            if a == sink:
                room = min(self.edges[k][1] for k in path)
                for k in path:
                    self.edges[k][1] -= room
                    self.edges[k ^ 1][1] += room
                path = path[: next(i for i, k in enumerate(path) if not self.edges[k][1])]
                continue
            while at[a] < len(self.out[a]):
                k = self.out[a][at[a]]
                if free(a, k) and level.get(self.edges[k][0]) == level[a] + 1:
                    path.append(k)
                    break
                at[a] += 1
            else:
                if not path:
                    return True
                at[self.edges[path.pop() ^ 1][0]] += 1


def transfers(sizes: dict[int, int], capacities: list[int]) -> dict[int, list[tuple[int, int]]]:
    """By old shard, (new shard, bytes) that cover its size, what stays first; sizes and capacities
    have one sum. Bytes of an old shard stay in the new one of its number or pass a hub, so edges
    are as many as shards."""
    olds, n = sorted(sizes), len(capacities)
    flow = Flow(len(olds) + n + 3)
    hub, source, sink = len(olds) + n, len(olds) + n + 1, len(olds) + n + 2
    stay, leave, enter = {}, {}, {}
    for i, old in enumerate(olds):
        flow.edge(source, i, sizes[old], 0)
        leave[old] = flow.edge(i, hub, sizes[old], 1)
        if old < n:
            stay[old] = flow.edge(i, len(olds) + old, sizes[old], 0)
    for j, room in enumerate(capacities):
        enter[j] = flow.edge(hub, len(olds) + j, room, 0)
        flow.edge(len(olds) + j, sink, room, 0)
    flow.solve(source, sink)
    wanted = deque([j, flow.sent(k)] for j, k in enter.items() if flow.sent(k))
    out: dict[int, list[tuple[int, int]]] = {}
    for old in olds:
        out[old] = [(old, flow.sent(stay[old]))] if old in stay and flow.sent(stay[old]) else []
        rest = flow.sent(leave[old])
        while rest:
            part = min(rest, wanted[0][1])
            out[old].append((wanted[0][0], part))
            rest -= part
            wanted[0][1] -= part
            if not wanted[0][1]:
                wanted.popleft()
    return out


def capacities(total: int, placed: list[int]) -> list[int]:
    """Bytes that each shard may still take so that all come to one level, given what it holds; a
    shard above the level takes none, and odd bytes go to the first shards."""
    order = sorted(range(len(placed)), key=lambda j: (placed[j], j))
    held = 0
    for k, j in enumerate(order):
        held += placed[j]
        level, odd = divmod(total + held, k + 1)
        if k + 1 == len(order) or level <= placed[order[k + 1]]:
            break
    out, low = [0] * len(placed), order[: k + 1]
    for j in sorted(low)[:odd]:
        out[j] = 1
    for j in low:
        out[j] += level - placed[j]
    return out


@dataclass
class Layout:
    """rows: the table's rows with their shard (int) and slot (long), columns named by them;
    manifest: (shard, file, rows, first), the slot of a file's first row; moved: bytes that
    changed their shard, of total."""

    rows: DataFrame
    manifest: DataFrame
    shard: str
    slot: str
    moved: int
    total: int


def row_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _free(names: list[str], name: str) -> str:
    while name.lower() in {n.lower() for n in names}:
        name += "_"
    return name


def _placed(spark: SparkSession, path: str, shards: int) -> DataFrame:
    """The table's rows with _old (shard), _file and _row, an order of all rows of an old shard.

    Files go by a hash of their name. Should two files share it, their rows interleave in that
    order and each still has one place."""
    file = F.xxhash64(F.col("_metadata.file_name"))
    rows = spark.read.parquet(path)
    nested = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_whole")
    return rows.select(nested, F.pmod(file, F.lit(shards)).cast("int").alias("_old"), file.alias("_file"), F.col("_metadata.row_index").alias("_row"))


def _cuts(small: DataFrame, sums: DataFrame, moves: dict[int, list[tuple[int, int]]]) -> list[tuple]:
    """(old shard, new shard, file, row): from that row of an old shard on, rows go to the new one.
    A row goes where its middle byte lies."""
    spark = small.sparkSession
    bounds = []
    for old, parts in moves.items():
        at = 0
        for j, (new, size) in enumerate(parts):
            if j:
                bounds.append((old, new, at))
            at += size
    out = [(old, parts[0][0], -(2**63), 0) for old, parts in moves.items()]
    if bounds:
        asked = F.broadcast(spark.createDataFrame(bounds, "_old int, new int, at long"))  # fewer than old and new shards
        along = Window.partitionBy("_old").orderBy("_file", "_chunk")
        marked = sums.withColumn("_until", F.sum("_bytes").over(along)).withColumn("_from", F.col("_until") - F.col("_bytes"))
        # The first middle from at on is in the chunk that holds at, or in the next one.
        near = marked.withColumn("_prior", F.coalesce(F.lag("_from").over(along), F.col("_from"))).join(asked, "_old").where("_prior <= at AND _until >= at")
        near = cut(near.select("_old", "_file", "_chunk", "_from", "new", "at"))
        within = Window.partitionBy("new", "at", "_old", "_file", "_chunk").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        rows = small.join(F.broadcast(near), ["_old", "_file", "_chunk"])  # at most three chunks a bound
        middle = F.col("_from") + F.coalesce(F.sum("_size").over(within), F.lit(0)) + F.col("_size") / 2
        first = rows.withColumn("_middle", middle).where("_middle >= at").groupBy("_old", "new", "at").agg(F.min(F.struct("_file", "_row")).alias("f"))
        out += [(r._old, r.new, r.f._file, r.f._row) for r in first.collect()]
    return out


def reshard(spark: SparkSession, path: str, shards: int = SHARDS, text: str = "text", folder: str | None = None) -> Layout:
    """Deals the rows of the Parquet table at path over shards of equal bytes, moving the fewest.

    A row's size is its text's UTF-8 bytes (null: none) and ROW_BYTES. Every row is kept, repeated
    ones each, whatever its id; columns stay as they are, and clashing names make the layout's own
    names longer. Files of the table that lose no row are part of the layout unchanged; the others
    are written again below folder (by default in the shared folder), which stays. A shard's bytes
    differ from the others' by about a row of at most a part in FINE of it, unless single larger
    rows exceed a shard. An empty table gives an empty layout.
    """
    rows = _placed(spark, path, shards)
    names = spark.read.parquet(path).columns
    sized = cut(rows.select("_old", "_file", "_row", row_bytes(F.col(f"_whole.`{text}`")).alias("_size"), F.floor(F.col("_row") / CHUNK).alias("_chunk")))
    total = sized.agg(F.sum("_size")).first()[0] or 0
    fine = total // (shards * FINE)
    big = [(r._size, r._file, r._row, r._old) for r in sized.where(F.col("_size") > fine).drop("_chunk").collect()]  # fewer than FINE * shards + 1
    held, homes = [0] * shards, []
    for size, file, row, old in sorted(big, key=lambda b: (-b[0], b[1], b[2])):
        to = old if (held[old] + size) * shards <= total else min(range(shards), key=lambda j: (held[j], j))
        held[to] += size
        homes.append((file, row, old, to, size))
    small = sized.where(F.col("_size") <= fine)
    sums = cut(small.groupBy("_old", "_file", "_chunk").agg(F.sum("_size").alias("_bytes")))
    sizes = {r._old: r.b for r in sums.groupBy("_old").agg(F.sum("_bytes").alias("b")).collect()}
    moves = transfers(sizes, capacities(sum(sizes.values()), held))
    cuts = _cuts(small, sums, moves)
    moved = sum(size for old, parts in moves.items() for new, size in parts if new != old) + sum(h[4] for h in homes if h[2] != h[3])

    # The row from which on rows leave their old shard, and files that single rows leave.
    leaves = {old: min([(f, r) for o, new, f, r in cuts if o == old and new != old], default=None) for old in sizes}
    gone = [h[0] for h in homes if h[2] != h[3]]
    touched = F.col("_file").isin(gone) if gone else F.lit(False)
    for old, first in leaves.items():
        if first:
            touched = touched | ((F.col("_old") == old) & (F.col("_file") >= first[0]))
    steps: dict[int, list] = defaultdict(list)
    for old, new, file, row in sorted(cuts, key=lambda c: (c[0], c[2], c[3])):
        steps[old].append((file, row, new))
    shard = F.col("_old")
    for old, parts in steps.items():
        here = F.lit(parts[0][2])
        for file, row, new in parts[1:]:
            here = F.when((F.col("_file") > file) | ((F.col("_file") == file) & (F.col("_row") >= row)), F.lit(new)).otherwise(here)
        shard = F.when(F.col("_old") == old, here).otherwise(shard)
    single = F.broadcast(spark.createDataFrame([(f, r, to) for f, r, _, to, _ in homes], "_file long, _row long, _home int"))  # as big
    key, place, slot = _free(names, "shard"), _free([*names, "shard"], "file"), _free(names, "slot")
    where = f"{(folder or shared_dir(spark)).rstrip('/')}/shards-{uuid.uuid4().hex}"
    again = rows.where(touched).join(single, ["_file", "_row"], "left").select("_whole.*", F.coalesce("_home", shard).cast("int").alias(key))
    again.write.partitionBy(key).parquet(where)

    columns = [F.col(f"`{c}`") for c in names]
    stay = rows.where(~touched).select("_whole.*", F.col("_old").alias(key), F.concat(F.lit("old:"), F.col("_metadata.file_name")).alias(place), F.col("_row").alias(slot))
    written = spark.read.schema(again.schema).parquet(where).select(*columns, key, F.concat(F.lit("new:"), F.col("_metadata.file_name")).alias(place), F.col("_metadata.row_index").alias(slot))
    both = stay.unionByName(written)
    files = both.groupBy(F.col(key).alias("shard"), F.col(place).alias("file")).agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    manifest = cut(files.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0))))
    few = manifest.count() <= FILES
    starts = manifest.select(F.col("shard").alias(key), F.col("file").alias(place), F.col("first").alias("_first"))
    laid = both.join(F.broadcast(starts) if few else starts, [key, place]).select(*columns, key, (F.col("_first") + F.col(slot)).alias(slot))
    return Layout(laid, manifest, key, slot, int(moved), int(total))


def shard_report(spark: SparkSession, path: str, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of the table: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null:
    the law deals by bytes). Read from the files of the new layout; odd rows as in reshard()."""
    layout = reshard(spark, path, shards, text)
    return layout.rows.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        row_bytes(F.col(f"`{text}`")).alias("size"),
        F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col(layout.shard).cast("int").alias("shard"),
        F.col(layout.slot).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
