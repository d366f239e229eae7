"""Jaccard join on word shingles: size-aware, heavy-light, exact.

Sets are the distinct five-word shingles of whole texts; two link when
100 * intersection >= 75 * union.

1. Counts of all shingles go into a sketch of fixed size.  Its cells give every
   shingle a rank level (rare first); any order that all tasks share is right,
   a good one keeps common passages out of prefixes.
2. Equal sets become one node.  A set of n shingles can only link through its
   first n - ceil(0.75 n) + 1 ones in that order.
3. Small sets (at most `boundary` shingles) enumerate all subsets of two of
   one more than that prefix; larger ones, and small ones of a size that may
   link with them, post single shingles to inverted lists.  The boundary is
   the size at which estimated costs of subsets and of list scans are least.
4. Light lists (at most LIGHT rows) give their pairs, counted over all lists; a
   pair that links must share so many keys.  They do so twice: first neighbours
   alone, by size and node, whose counts join near copies already; then all
   pairs that this left apart.  So a cluster of near copies takes rows in
   proportion to its postings, not to the square of its members a posting, and
   the components are those of all pairs.  Heavy lists are sorted by size, and
   neighbours that sizes let link are joined: L rows give L - 1 edges, never
   L * L, and every pair that may link is in one component.  Lists of common
   shingles are salted; the unbroken runs of their parts are joined where sizes
   let link, which gives the components of the whole list.
5. Each component's sets meet once: a small one as one group, a large one as
   blocks by size class and salt, each two that sizes let link.  Blocks are
   stored once, in files of the shared folder that tasks read by ranges, so a
   large component's sets take disk in proportion to their number.  There all
   intersections are counted and the links come out, each from the one group
   that owns it: the group of its two blocks, or of its one block with itself.
6. Components of the links, the smallest doc_id of each, and links a document,
   copies counted in.

Node keys are 64 bits of a digest of the set (a false merge of n distinct sets
has a chance of n * n / 2 ** 65).  Empty sets link with nothing.  Null texts
are empty; long texts give all their shingles; ties between shingles of one
level go by hash; an empty table gives no rows; columns besides doc_id and text
don't matter, whatever they are called; rows of one doc_id with unlike texts are documents that share an
id; repeated rows are copies; a null doc_id never names a component unless all
its members have none.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bits_of, few_large_tasks, forget, has_bits, merged_tables, remove, scratch, shuffles_go, spread_join, table, trim, written
from .components import components, roots
from .shingles import HASH_BITS, MASK, blocks, buffers, mix, ordered_sets
from .warc import files_of

#: Cells of the sketch, and the pieces in which it travels (16 MB of counts reach the driver, 4 MB each task).
CELLS, PIECES = 1 << 22, 64
#: Boundaries up to this size are weighed.
MOST_SMALL = 64
#: Documents of a block; a component of no more is one group.
BLOCK = 256
#: Rows of a list that gives its pairs.
LIGHT = 32
#: Rows of a salted part of a common list, about.
LIST_ROWS = 1 << 14
#: Bits of the filter of documents whose sets are wanted.
FILTER_BITS = 1 << 24
#: Size classes grow by sqrt(4 / 3): two sets that link are two classes apart at most.
_CLASS = 0.5 * np.log(4 / 3)
_PAIR = np.uint64(1 << 62)


def need(n: np.ndarray) -> np.ndarray:
    """The least intersection that a set of n has with one that it links with: ceil(0.75 n)."""
    return (3 * n + 3) // 4


def sketch(docs: DataFrame) -> np.ndarray:
    """Counts of shingles (once a document) by cell, over all documents."""
    size = CELLS // PIECES

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.uint32)
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            for i, j in blocks(off):
                h, _, _ = ordered_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                cell, n = np.unique((h & np.uint64(CELLS - 1)).astype(np.int64), return_counts=True)
                total[cell] += n.astype(np.uint32)
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([zlib.compress(total[p * size : (p + 1) * size].tobytes(), 1) for p in range(PIECES)], pa.binary())], ["piece", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[piece] = sums.get(piece, np.uint32(0)) + np.frombuffer(zlib.decompress(counts), np.uint32)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], ["piece", "counts"])

    parts = merged_tables(few_large_tasks(docs.select("text"), 2).mapInArrow(gather, "piece int, counts binary"), merge, PIECES)
    out = np.zeros(CELLS, np.uint32)
    with shuffles_go(docs.sparkSession):
        found = parts.collect()
    for piece, counts in found:
        out[piece * size : (piece + 1) * size] = np.frombuffer(zlib.decompress(counts), np.uint32)
    return out


def levels(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank level of each cell, 0 to 31; the least count of each level).

    Half steps of a standard deviation around the mean load, then doublings: a
    shingle of a few dozen documents already comes behind those that chance
    puts into a cell, so a prefix is made of what is rare.
    """
    mean = max(float(cells.mean()), 1.0)
    near = mean + np.arange(-2, 13) * 0.5 * mean**0.5
    least = np.concatenate([[0.0], near, near[-1] * 2.0 ** np.arange(1, 17)])
    return (np.searchsorted(least, cells, "right") - 1).astype(np.uint8), least


def expected_count(level: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Documents of a shingle, estimated from its level: what its cell holds beyond the mean load, 1 at least."""
    return np.maximum(1.0, least - least[3])[level]


def _set_rows(batch: pa.RecordBatch, level: np.ndarray):
    """Blocks of a batch: (first row, sizes, starts, hashes in order, levels, digests)."""
    raw, off = buffers(batch.column("text"))
    for i, j in blocks(off):
        h, lv, n = ordered_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], level)
        start = np.concatenate([[0], np.cumsum(n)])
        digest = np.zeros(j - i, np.uint64)
        some = np.flatnonzero(n)
        if len(some):
            digest[some] = mix(np.add.reduceat(mix(h + np.uint64(0x5851F42D4C957F2D)), start[some]) + n[some].astype(np.uint64))
        yield i, j, n, start, h, lv, digest.view(np.int64)


def _pack(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8]


def _unpack(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").ravel()


def _binary(parts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column from bytes end to end."""
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(parts).tobytes())])


def _described(docs: DataFrame, level, least: np.ndarray) -> DataFrame:
    """doc_id, n, node, scan (estimated rows of the prefix's lists), head (prefix and one more: hash bytes), ranks (their levels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, n, start, h, lv, digest in _set_rows(batch, level.value):
                p = np.where(n > 0, np.minimum(n, n - need(n) + 2), 0)
                at = np.arange(int(p.sum())) + np.repeat(start[:-1] - (np.cumsum(p) - p), p)
                cost = np.bincount(np.repeat(np.arange(j - i), p), expected_count(lv[at], least), j - i)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(digest), pa.array(cost.astype(float)), _binary(_pack(h[at]), 6 * p), _binary(lv[at], p)], ["doc_id", "n", "node", "scan", "head", "ranks"])
        trim()

    return docs.mapInArrow(run, "doc_id long, n long, node long, scan double, head binary, ranks binary")


def boundary_of(sizes: list[tuple[int, int, float]]) -> int:
    """From (size, sets, estimated list rows): the boundary of least cost, counted in rows made and scanned."""
    by = {n: (count, scan) for n, count, scan in sizes}
    best, chosen = None, 0
    for b in range(MOST_SMALL + 1):
        cost = 0.0
        for n, (count, scan) in by.items():
            p = n - int(need(np.int64(n))) + 2
            if 3 <= n <= b:
                cost += count * min(n, p) * (min(n, p) - 1) / 2
            if n > b or 4 * n >= 3 * (b + 1):
                cost += scan
        if best is None or cost < best:
            best, chosen = cost, b
    return chosen


def _postings(nodes: DataFrame, boundary: int, least: np.ndarray) -> DataFrame:
    """(key, n, node, and root if nodes have it): subsets of two for small sets, single shingles for the rest; common keys carry a salt."""
    more = ["root"] if "root" in nodes.columns else []

    def salted(key: np.ndarray, lv: np.ndarray, node: np.ndarray) -> np.ndarray:
        parts = np.maximum(1, expected_count(lv, least) / LIST_ROWS).astype(np.uint64)
        salt = np.where(parts > 1, mix(node.view(np.uint64)) % parts + np.uint64(1), 0).astype(np.uint64)
        return (key & ~(np.uint64(0x3FFF) << np.uint64(HASH_BITS))) | np.minimum(salt, np.uint64(0x3FFF)) << np.uint64(HASH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node = batch.column("n").to_numpy(), batch.column("node").to_numpy()
            raw, off = buffers(batch.column("head"))
            ranks, roff = buffers(batch.column("ranks"))
            h = _unpack(raw)
            p = np.diff(roff)
            first = roff[:-1]
            # single shingles: the prefix without the one more
            single = (n > boundary) | (4 * n >= 3 * (boundary + 1))
            single &= n >= 3
            q = np.where(single, np.minimum(p, n - need(n) + 1), 0)
            at = np.arange(int(q.sum())) + np.repeat(first - (np.cumsum(q) - q), q)
            row = np.repeat(np.arange(len(n)), q)
            keys, rows = [salted(h[at], ranks[at], node[row])], [row]
            small = np.flatnonzero((n >= 3) & (n <= boundary))
            for size in np.unique(p[small]):
                own = small[p[small] == size]
                i, j = np.triu_indices(int(size), 1)
                a, b = first[own][:, None] + i, first[own][:, None] + j
                low, high = np.minimum(h[a], h[b]), np.maximum(h[a], h[b])
                row = np.repeat(own, len(i))
                keys.append(salted((mix(low * np.uint64(3) + mix(high)) & MASK).ravel() | _PAIR, np.minimum(ranks[a], ranks[b]).ravel(), node[row]))
                rows.append(row)
            key, row = np.concatenate(keys), np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n[row].astype(np.int32)), pa.array(node[row]), *(batch.column(c).take(pa.array(row)) for c in more)], ["key", "n", "node", *more])
        trim()

    return nodes.select("n", "node", "head", "ranks", *more).mapInArrow(run, "key long, n int, node long" + ", root long" * len(more))


def _lists(batches: Iterator[pa.RecordBatch], boundary: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, n and node, as lists: kind 0 pairs (a, b) of a light list with their sizes and counts,
    kind 1 the chain of a heavy one, kind 2 each unbroken run of a salted part's chain as (key, first node, least n, most n).

    Without roots the pairs are neighbours; with a fourth column, root, they are all pairs of unlike roots (0: none),
    and of heavy lists nothing comes."""
    carry, inside = None, False

    def rows(kind: int, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(na), pa.array(nb), pa.array(count)], ["kind", "a", "b", "na", "nb", "count"])

    def settle(key: np.ndarray, n: np.ndarray, node: np.ndarray, root: np.ndarray | None, inside: bool) -> Iterator[pa.RecordBatch]:
        """inside: the first list goes on a chain that began before."""
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        salted = (key[start] >> HASH_BITS) & 0x3FFF > 0
        heavy = (size > LIGHT) | salted
        heavy[0] |= inside
        if root is None:
            own = np.repeat(heavy, size)
            link = own[1:] & (key[1:] == key[:-1]) & (4 * n[:-1] >= 3 * n[1:])
            a, b = node[:-1][link], node[1:][link]
            if len(a):
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                none = np.zeros(len(both), np.int64)
                yield rows(1, both[:, 0], both[:, 1], none, none, none)
            # a run that goes on in the next batch comes as two that share a size
            head = np.flatnonzero(np.concatenate([[True], ~link]))
            end = np.append(head[1:], len(key)) - 1
            of_salted = np.repeat(salted, size)[head]
            head, end = head[of_salted], end[of_salted]
            if len(head):
                yield rows(2, key[head] & ~np.int64(0x3FFF << HASH_BITS), node[head], n[head], n[end], np.zeros(len(head), np.int64))
        parts = []
        ids, code = np.unique(node, return_inverse=True)
        for length in np.unique(size[~heavy]):
            if length > 1:
                first = start[~heavy & (size == length)]
                i, j = (np.arange(length - 1), np.arange(1, length)) if root is None else np.triu_indices(int(length), 1)
                x, y = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
                # two small sets meet in subsets of two
                good = (4 * n[x] >= 3 * n[y]) & ((n[y] > boundary) | (key[x] & (1 << 62) != 0)) & (code[x] != code[y])
                if root is not None:
                    good &= (root[x] != root[y]) | (root[x] == 0)
                parts.append(np.stack([x[good], y[good]], 1))
        if parts and sum(map(len, parts)):
            x, y = np.concatenate(parts).T
            low = node[x] < node[y]
            x, y = np.where(low, x, y), np.where(low, y, x)
            pair, at, count = np.unique(code[x] * np.int64(len(ids)) + code[y], return_index=True, return_counts=True)
            yield rows(0, node[x[at]], node[y[at]], n[x[at]], n[y[at]], count.astype(np.int64))

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy().astype(np.int64) for c in batch.columns]
        key, n, node, *root = now if carry is None else [np.concatenate(x) for x in zip(carry, now, strict=True)]
        last = int(np.searchsorted(key == key[-1], True)) if key[0] != key[-1] else 0
        long = len(key) - last > LIGHT or (inside and last == 0) or (int(key[-1]) >> HASH_BITS) & 0x3FFF > 0
        until = len(key) if long else last
        if until:
            yield from settle(key[:until], n[:until], node[:until], root[0][:until] if root else None, inside)
            inside = long
        keep = len(key) - 1 if long else last
        carry = [x[keep:] for x in (key, n, node, *root)]
    if carry and len(carry[0]) and not inside:
        yield from settle(*carry, *[None] * (4 - len(carry)), False)


def _candidates(nodes: DataFrame, boundary: int, least: np.ndarray) -> DataFrame:
    """(node, root) of the components of edges that hold every pair that may link.

    A pair that links shares at least need(n + m) - need(max) + 1 keys of the two prefixes;
    if all its lists are light they were all counted, else a chain joins it.
    """

    def lists(nodes: DataFrame) -> DataFrame:
        rows = _postings(nodes, boundary, least).repartition("key").sortWithinPartitions("key", "n", "node")
        return written(rows.mapInArrow(lambda b: _lists(b, boundary), "kind int, a long, b long, na long, nb long, count long"), "lists")

    def light(found: DataFrame) -> DataFrame:
        pairs = found.where("kind = 0").groupBy("a", "b").agg(F.sum("count").alias("count"), F.first("na").alias("na"), F.first("nb").alias("nb"))
        most = F.greatest("na", "nb")
        fewest = F.expr("(3 * (na + nb) + 6) div 7") - F.expr("(3 * greatest(na, nb) + 3) div 4") + 1
        return pairs.where((most <= boundary) | (F.col("count") >= fewest)).select("a", "b")

    found = lists(nodes)
    # runs of all parts of a list in order of their least size: one goes on where that may link with the most before it,
    # as in a list without a salt; a part has no more runs than sizes have steps of 4 / 3
    runs = found.where("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("node"), F.col("na").alias("low"), F.col("nb").alias("high")).distinct()
    order = Window.partitionBy("key").orderBy("low", "node", "high")
    before = runs.select("low", F.col("node").alias("b"), F.lag("node").over(order).alias("a"), F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("most"))
    joined = before.where("4 * most >= 3 * low AND a <> b").select("a", "b")
    near = components(light(found).unionByName(found.where("kind = 1").select("a", "b").distinct()).unionByName(joined))
    forget(found)
    # a pair within a component adds nothing to it; the counts of others are those of all lists
    flagged = nodes.withColumn("_near", _in_filter(_filter(near, "node"), nodes.sparkSession)(_bit(F.col("node"))))
    rooted = flagged.where("_near").drop("_near").join(near, "node", "left").withColumn("root", F.coalesce("root", F.lit(0).cast("long")))
    found = lists(rooted.unionByName(flagged.where("NOT _near").drop("_near").withColumn("root", F.lit(0).cast("long"))))
    more = written(light(found), "more")
    forget(found)
    rough = near if more.isEmpty() else components(more.unionByName(near.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    forget(more, *[near] * (rough is not near))
    return rough


def _placed(members: DataFrame) -> DataFrame:
    """members (node, n, copies, root) with their size class, the size of their component (all) and, of a large one, the block's salt s among salts[class]."""
    members = members.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(_CLASS))).cast("int"))
    counts = members.groupBy("root", "class").agg(F.count(F.lit(1)).alias("rows"))
    shape = counts.groupBy("root").agg(F.sum("rows").alias("all"), F.map_from_entries(F.collect_list(F.struct("class", F.ceil(F.col("rows") / BLOCK).cast("int")))).alias("salts"))
    return members.join(shape, "root").withColumn("s", F.pmod(F.xxhash64("node"), F.element_at("salts", F.col("class"))).cast("int"))


def _whole_groups(placed: DataFrame) -> DataFrame:
    """(node, copies, group, second) of components that are one group each."""
    return placed.where(F.col("all") <= BLOCK).select("node", "copies", F.struct("root", F.lit(0).alias("c1"), F.lit(0).alias("s1"), F.lit(0).alias("c2"), F.lit(0).alias("s2")).alias("group"), F.lit(False).alias("second"))


def _block_groups(placed: DataFrame) -> DataFrame:
    """(node, copies, group, second) of large components, one group for each two of their blocks that may link; second: the
    row's block is the second of two. Only for stores that tasks can't read by ranges: each set goes to all its groups."""
    large = placed.where(F.col("all") > BLOCK)
    salts = lambda d: F.coalesce(F.try_element_at("salts", F.col("class") + d), F.lit(0))
    block = lambda d, s: F.struct((F.col("class") + d).alias("c"), s.cast("int").alias("s"))
    blocks_of = lambda d: F.transform(F.slice(F.sequence(F.lit(0), salts(d)), F.lit(1), salts(d)), lambda s: block(d, s))
    large = large.withColumn("other", F.explode(F.flatten(F.array(*[blocks_of(d) for d in range(-2, 3)]))))
    mine, theirs = F.struct(F.col("class").alias("c"), F.col("s").alias("s")), F.col("other")
    one, two = F.least(mine, theirs), F.greatest(mine, theirs)
    return large.select("node", "copies", F.struct("root", one["c"].alias("c1"), one["s"].alias("s1"), two["c"].alias("c2"), two["s"].alias("s2")).alias("group"), (mine > theirs).alias("second"))


def _stored_blocks(placed: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """(root, class, s, path, at, size, raw): where in the folder's files each block of a large component stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, name, found, at = None, f"{folder}/{uuid.uuid4().hex}", [], 0
        key, nodes, copies, packed = None, [], [], []

        def put(file) -> int:
            sizes = np.array([len(x) for x in packed], np.int64)
            raw = np.array([len(nodes)], np.int64).tobytes() + np.array(nodes, np.int64).tobytes() + np.array(copies, np.int64).tobytes() + sizes.tobytes() + b"".join(packed)
            content = pa.compress(raw, codec="zstd", asbytes=True)
            file.write(content)
            found.append((*key, name, at, len(content), len(raw)))
            return at + len(content)

        file = None
        try:
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in ("root", "class", "s", "node", "copies", "shingles")), strict=True)
                for *here, node, n, shingles in rows:
                    if here != key:
                        if file is None:
                            store, place = files_of(name)
                            store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                            file = store.open_output_stream(place)
                        if nodes:
                            at = put(file)
                        key, nodes, copies, packed = here, [], [], []
                    if not nodes or nodes[-1] != node:  # copies may have come through the filter
                        nodes.append(node)
                        copies.append(n)
                        packed.append(shingles)
            if nodes:
                at = put(file)
        finally:
            if file is not None:
                file.close()
        trim()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], schema=pa.schema([("root", pa.int64()), ("class", pa.int32()), ("s", pa.int32()), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("raw", pa.int64())]))

    rows = placed.where(F.col("all") > BLOCK).select("root", "class", "s", "node", "copies").join(sets, "node").repartition("root", "class", "s").sortWithinPartitions("root", "class", "s", "node")
    return rows.select("root", "class", "s", "node", "copies", "shingles").mapInArrow(run, "root long, class int, s int, path string, at long, size long, raw long")


def _block_pairs(index: DataFrame) -> DataFrame:
    """Each two blocks of a component that sizes let link, and each with itself, dealt to tasks."""
    block = F.struct("class", "s", "path", "at", "size", "raw")
    one, two = index.select("root", block.alias("one")), index.select("root", block.alias("two"))
    pairs = one.join(two, "root").where("(one.class, one.s) <= (two.class, two.s) AND two.class - one.class <= 2")
    # by number: rows are few and small, their work is not
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), index.sparkSession.sparkContext.defaultParallelism)
    return pairs.repartition(tasks, "root", "one", "two").sortWithinPartitions("root", "one", "two")


def _links_of_blocks(batches: Iterator[pa.RecordBatch], pairs: bool) -> Iterator[pa.RecordBatch]:
    """As _links, over rows of _block_pairs."""
    held: dict[tuple, tuple] = {}

    def block(where: dict) -> tuple[list[int], list[int], list[np.ndarray]]:
        store, place = files_of(where["path"])
        with store.open_input_file(place) as f:
            f.seek(where["at"])
            raw = pa.decompress(f.read(where["size"]), where["raw"], codec="zstd", asbytes=True)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        nodes, copies, sizes = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n)
        end = 8 + 24 * n + np.cumsum(sizes)
        return nodes.tolist(), copies.tolist(), [_unpack(np.frombuffer(raw, np.uint8, int(k), int(e - k))) for k, e in zip(sizes, end, strict=True)]

    for batch in batches:
        for one, two in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True):
            name = (one["path"], one["at"])
            if name not in held:
                held = {name: block(one)}
            nodes, copies, sets = held[name]
            if one == two:
                yield from _owned(nodes, copies, [False] * len(nodes), sets, True, pairs)
            else:
                more = block(two)
                yield from _owned(nodes + more[0], copies + more[1], [False] * len(nodes) + [True] * len(more[0]), sets + more[2], False, pairs)
    trim()


def _filter(ids: DataFrame, key: str) -> np.ndarray:
    """FILTER_BITS bits; those that stand for the column's values are set."""
    bit = _bit(F.col(key))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 AS int))")).alias("bits"))
    with shuffles_go(ids.sparkSession):
        return bits_of(words.collect(), FILTER_BITS)


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def _in_filter(filled: np.ndarray, spark: SparkSession):
    """A function of a column of bits: whether they are set."""
    shared = spark.sparkContext.broadcast(filled)

    @F.arrow_udf("boolean")
    def held(bits: pa.Array) -> pa.Array:
        return pa.array(has_bits(shared.value, bits.to_numpy(zero_copy_only=False)))

    return held


def _wanted_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the documents in wanted (doc_id); a filter of FILTER_BITS bits may let others through."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(wanted, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(1, np.uint8)
        for batch in batches:
            batch = batch.filter(pa.array(has_bits(shared.value, batch.column("bit").to_numpy())))
            if batch.num_rows:
                for _, _, n, _, h, _, digest in _set_rows(batch, flat):
                    yield pa.RecordBatch.from_arrays([pa.array(digest), _binary(_pack(h), 6 * n)], ["node", "shingles"])
        trim()

    return docs.select("text", _bit(F.col("doc_id")).alias("bit")).mapInArrow(run, "node long, shingles binary")


def _group_links(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links of a group: (first, second, shingles that they share)."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    h, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df[code] > 1
    code, owner = code[keep], owner[keep]
    renumber = np.cumsum(df > 1) - 1
    code = renumber[code]
    total = int((df > 1).sum())
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, (1 << 21) // len(sets))
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for at in range(0, total, width):
        lo, hi = np.searchsorted(code, [at, at + width])
        held = np.zeros((len(sets), min(width, total - at)), np.float32)
        held[owner[lo:hi], code[lo:hi] - at] = 1
        both += held @ held.T
    both = both.astype(np.int64)
    a, b = np.nonzero(np.triu(100 * both >= 75 * (n[:, None] + n - both), 1))
    return a, b, both[a, b]


#: A link: its two nodes, shingles of both, copies and shingles of each.
_LINK = "a long, b long, n_shared long, a_copies long, b_copies long, na long, nb long"
#: A node that has links in a group: the first node that they join it to there, and the documents that they lead to.
_EDGE = "a long, b long, others long"


def _owned(nodes: list[int], copies: list[int], second: list[bool], sets: list[np.ndarray], one: bool, pairs: bool) -> Iterator[pa.RecordBatch]:
    """The links that a group owns, or a row for each of its nodes that has some. one: the group is one block or a whole component."""
    ids, first = np.unique(np.array(nodes, np.int64), return_index=True)
    if len(ids) < 2:
        return
    own = [sets[k] for k in first]
    a, b, shared = _group_links(own)
    side = np.array(second)[first]
    # two blocks: links within one of them belong to that block's own group
    mine = (side[a] != side[b]) | one
    a, b, shared = a[mine], b[mine], shared[mine]
    n, c = np.array([len(s) for s in own], np.int64), np.array(copies, np.int64)[first]
    if not pairs:
        others = np.zeros(len(ids), np.int64)
        np.add.at(others, a, c[b])
        np.add.at(others, b, c[a])
        some = np.flatnonzero(others)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[roots(a, b, len(ids))[some]]), pa.array(others[some])], ["a", "b", "others"])
        return
    for at in range(0, len(a), 1 << 16):
        x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[x], ids[y], shared[at : at + (1 << 16)], c[x], c[y], n[x], n[y])], [f.split()[0] for f in _LINK.split(", ")])


def _links(batches: Iterator[pa.RecordBatch], pairs: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: what each group owns."""
    last, nodes, copies, second, sets = None, [], [], [], []

    def owned() -> Iterator[pa.RecordBatch]:
        return _owned(nodes, copies, second, sets, last[1:3] == last[3:5], pairs)

    for batch in batches:
        groups = batch.column("group").flatten()
        keys = list(zip(*(g.to_pylist() for g in groups), strict=True))
        raw, off = buffers(batch.column("shingles"))
        of = zip(keys, *(batch.column(c).to_pylist() for c in ("node", "copies", "second")), strict=True)
        for k, (key, node, n, side) in enumerate(of):
            if key != last:
                if len(nodes) > 1:
                    yield from owned()
                last, nodes, copies, second, sets = key, [], [], [], []
            nodes.append(node)
            copies.append(n)
            second.append(side)
            sets.append(_unpack(raw[off[k] : off[k + 1]]))
    if len(nodes) > 1:
        yield from owned()


def _node_of(text: str) -> Column:
    """The node of a text's set, 0 for an empty one."""

    @F.arrow_udf("long")
    def node(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts.cast(pa.string())], ["text"])
        found = [digest for *_, digest in _set_rows(batch, np.zeros(1, np.uint8))]
        return pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))

    return node(text)


def ngram_join(docs: DataFrame, with_pairs: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(rows, pairs) of docs (doc_id, text).  Tables go as soon as the next ones stand; those of pairs only without with_pairs.

    rows: doc_id, n_shingles, component_id, copies (documents with the same set), n_links (other documents that this one
    links with, those of its own set among them) and node (its set) for every row of docs.
    pairs: doc_id, other_id, n_shingles, other_shingles, n_shared, copies, other_copies for every link of two distinct
    sets, each link once and each set by its smallest doc_id.  They grow with the square of a group's sets and are made
    only when they are read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    level, least = levels(sketch(docs))
    shared = docs.sparkSession.sparkContext.broadcast(level)
    sets = written(_described(docs, shared, least), "sets")
    every = written(sets.select("doc_id", "n", "node"), "rows")
    nodes = every.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes, "nodes")
    # one row for each node: that of its smallest doc_id
    heads = sets.where("n >= 3").join(nodes.select("node", "doc_id"), ["node", "doc_id"], "left_semi")
    # sets of which no row has an id
    unnamed = sets.where("n >= 3 AND doc_id IS NULL").join(nodes.where("doc_id IS NULL").select("node"), "node", "left_semi").dropDuplicates(["node"])
    heads = written(heads.unionByName(unnamed).select("n", "node", "head", "ranks"), "heads")
    sizes = sets.where(F.col("n").between(3, 2 * MOST_SMALL)).groupBy("n").agg(F.count(F.lit(1)), F.sum("scan")).collect()
    boundary = boundary_of([tuple(r) for r in sizes])
    forget(sets)
    rough = _candidates(heads, boundary, least)
    members = written(rough.join(nodes, "node"), "members")
    forget(heads, rough)
    sets = _wanted_sets(docs, members)
    placed = _placed(members)
    folder = scratch(docs.sparkSession, "blocks")
    ranges = files_of(folder) is not None
    groups = _whole_groups(placed) if ranges else _whole_groups(placed).unionByName(_block_groups(placed))
    met = groups.join(sets, "node").repartition("group").sortWithinPartitions("group", "node")
    met = met.select("group", "node", "copies", "second", "shingles")
    index = written(_stored_blocks(placed, sets, folder), "index") if ranges and not placed.where(F.col("all") > BLOCK).isEmpty() else None

    def linked(pairs: bool) -> DataFrame:
        schema = _LINK if pairs else _EDGE
        near = met.mapInArrow(lambda b: _links(b, pairs), schema)
        return near if index is None else near.unionByName(_block_pairs(index).mapInArrow(lambda b: _links_of_blocks(b, pairs), schema))

    links = written(linked(False), "links")
    if not with_pairs and index is not None:
        forget(index)
        remove(docs.sparkSession, folder)
    roots_of = components(links)
    final = roots_of.join(nodes.select("node", "doc_id"), "node")
    names = final.groupBy("root").agg(F.min("doc_id").alias("component"))
    led = final.join(names, "root").join(links.groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others")), "node").select("node", "component", "others")
    named = nodes.select("node", "doc_id", "copies").join(led, "node", "left").select("node", "copies", F.coalesce("component", "doc_id").alias("component"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    named = written(named, "named")
    forget(nodes, links, roots_of)
    # copies of one set may be a large share of all rows
    out = spread_join(every.select("doc_id", "n", "node"), named, "node", "copies", "left")
    rows = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "node")
    if not with_pairs:
        return rows, None
    ids = members.select("node", "doc_id")
    pairs = linked(True).join(ids.withColumnsRenamed({"node": "a"}), "a").join(ids.withColumnsRenamed({"node": "b", "doc_id": "other_id"}), "b")
    return rows, pairs.select("doc_id", "other_id", F.col("na").alias("n_shingles"), F.col("nb").alias("other_shingles"), "n_shared", F.col("a_copies").alias("copies"), F.col("b_copies").alias("other_copies"))


def ngram_components(docs: DataFrame) -> DataFrame:
    """The rows of ngram_join without their node."""
    return ngram_join(docs, with_pairs=False)[0].drop("node")


def ngram_pairs(docs: DataFrame) -> DataFrame:
    """The pairs of ngram_join."""
    return ngram_join(docs)[1]


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that name their component, with all their columns; rows of an empty set or a null doc_id stay.

    Rows that repeat the doc_id that stays are that document and stay with it; of unlike texts that share an id only those
    go whose own component has another name.
    """
    rows = ngram_join(docs, with_pairs=False)[0].where("doc_id IS NOT NULL")
    goes = (F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id"))
    # the ids of the rows that go are few; only rows that have one may be dropped
    ids = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.bool_and(goes).alias("_all"), F.bool_or(goes).alias("_some")).where("_some")
    ids = written(ids, "gone")
    own = F.col("doc_id").cast("long")
    # the join takes rows that a filter of these ids lets through: other texts cross no shuffle
    flag = "_" + uuid.uuid4().hex
    flagged = docs.withColumn(flag, _in_filter(_filter(ids, "_id"), docs.sparkSession)(_bit(own)))
    rest, hit = flagged.where(~F.col(flag)).drop(flag), flagged.where(F.col(flag)).drop(flag)
    kept = rest.unionByName(hit.join(ids, own == ids["_id"], "left_anti"))
    # ids of which some rows go and some stay: which, their sets tell
    mixed = ids.where("NOT _all").select("_id")
    if mixed.isEmpty():
        return kept
    gone = rows.where(goes).select(F.col("doc_id").alias("_gone"), F.col("node").alias("_set")).distinct()
    split = hit.join(mixed, own == mixed["_id"], "left_semi").withColumn("_node", _node_of("text"))
    return kept.unionByName(split.join(gone, (F.col("doc_id").cast("long") == gone["_gone"]) & (F.col("_node") == gone["_set"]), "left_anti").drop("_node"))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) BETWEEN 1 AND 4 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k : k + 4], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM s),
g AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b, shared = x.n AND shared = y.n AS same FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
component AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1),
counted AS (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (same) AS copies FROM links GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, 1 + coalesce(copies, 0) AS copies, coalesce(n_links, 0) AS n_links FROM n JOIN component USING (doc_id) LEFT JOIN counted USING (doc_id)
"""
