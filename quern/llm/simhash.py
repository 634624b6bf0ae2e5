"""SimHash near-dedup through a segment-popcount embedding.

A fingerprint's 64 bits fall into 32 two-bit segments; the vector of their bit counts is the
embedding. The Manhattan distance of two vectors never exceeds the Hamming distance of the
fingerprints, so it prunes without loss. Counts are written in unary (00, 01, 11): the
Manhattan distance is then the popcount of an XOR, and a grid cell is a masked value.

The grid: segments are dealt to BLOCKS blocks. Vectors at distance d or less differ in at most d
segments, hence agree in at least BLOCKS - d whole blocks; every choice of that many blocks is a
coordinate plane of the grid, and two near vectors share a cell in one plane at least. Within a
cell the range join keeps pairs at Manhattan distance d or less and verifies them exactly by
Hamming distance. A cell emits a spanning forest of its links, never all its pairs. Cells are
counted first, with partial aggregation; one of more than CELL_LIMIT fingerprints never goes to
one task, but is dealt out as pairs of blocks of CELL_BLOCK fingerprints, each compared whole,
so that every task's memory is bounded.

Components then come from alternating large-star and small-star rounds over written tables.

Null and empty texts, and texts of white space, have fingerprint zero and are linked like any
other. A text of fewer words than a shingle is one shingle. Repeated rows share a fingerprint.
A component's id is its smallest non-null doc_id. An empty table gives an empty result. Only
the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, documents, salted_join

SHINGLE = 4
NEAR = 4
BLOCKS = 7
CELL_LIMIT = 1 << 15
CELL_BLOCK = 1 << 13
LOW = 0x5555555555555555


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned; a bit is set if it is in over half of the shingles' hashes."""
    w = text.lower().split()  # of bytes: A-Z alone are lowered, ASCII white space alone splits
    if not w:
        return 0
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), 42)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(w) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    n = len(w) - shingle + 1
    votes = np.zeros(64, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in spans], repeat(42)), np.uint64, n)
    for i in range(0, n, 1 << 16):
        part = h[i : i + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprint_column(text, shingle: int = SHINGLE):
    """The fingerprint of a text column as a signed long."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        fps = [fingerprint((t.as_py() or "").encode(), shingle) for t in texts]
        return pa.array(np.array(fps, np.uint64).view(np.int64))

    return run(text)


def unary(fp: np.ndarray) -> np.ndarray:
    """The embedding: each two-bit segment's bit count in unary."""
    low = np.uint64(LOW)
    shifted = fp >> np.uint64(1)
    return ((fp | shifted) & low) | (((fp & shifted) & low) << np.uint64(1))


def planes(near: int, blocks: int) -> list[int]:
    """Masks of the grid's planes: each choice of blocks - near blocks of segments."""
    masks = []
    for i in range(blocks):
        a, b = 32 * i // blocks, 32 * (i + 1) // blocks
        masks.append(sum(3 << (2 * s) for s in range(a, b)))
    return [sum(c) for c in combinations(masks, blocks - near)]


def _cells(near: int, blocks: int):
    masks = np.array(planes(near, blocks), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(i, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                u = unary(fp.view(np.uint64))
                cell = (u[None, :] & masks[:, None]).ravel().view(np.int64)
                plane = np.repeat(np.arange(len(masks), dtype=np.int16), len(fp))
                yield pa.RecordBatch.from_arrays([pa.array(plane), pa.array(cell), pa.array(np.tile(fp, len(masks)))], ["plane", "cell", "fp"])

    return run


def links_within(fp: np.ndarray, near: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among fp, as pairs of arrays.

    Breadth first: each reached fingerprint takes with it all unreached ones that are near, by
    the Manhattan bound first and the Hamming distance after. Stops when none is unreached.
    """
    left, u = fp, unary(fp)
    while len(left) > 1:
        queue, left, u = [(left[0], u[0])], left[1:], u[1:]
        while queue and len(left):
            x, ux = queue.pop()
            close = np.bitwise_count(u ^ ux) <= near
            close[close] = np.bitwise_count(left[close] ^ x) <= near
            if close.any():
                yield np.full(int(close.sum()), x), left[close]
                queue += zip(left[close], u[close])
                left, u = left[~close], u[~close]


#: Cells of up to so many fingerprints are compared pair by pair in one vectorised pass.
SMALL_CELL = 32


def _links_in_runs(fp: np.ndarray, starts: np.ndarray, near: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of consecutive runs of fp; starts holds each run's first index and len(fp)."""
    size = np.diff(starts)
    small = size <= SMALL_CELL
    run = np.repeat(np.arange(len(size)), size)
    u = unary(fp)
    for lag in range(1, int(size[small].max(initial=1))):
        i = np.flatnonzero((run[lag:] == run[:-lag]) & small[run[lag:]])
        i = i[np.bitwise_count(u[i] ^ u[i + lag]) <= near]
        i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= near]
        if len(i):
            yield fp[i], fp[i + lag]
    for k in np.flatnonzero(~small):
        yield from links_within(fp[starts[k] : starts[k + 1]], near)


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The links among what one task has just compared, as stars around their smallest members."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    for xs, ys in pairs:
        for x, y in zip(xs.view(np.int64).tolist(), ys.view(np.int64).tolist()):
            a, b = find(x), find(y)
            root[max(a, b)] = root[min(a, b)] = min(a, b)
    stars = [(x, find(x)) for x in root if find(x) != x]
    return pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars], pa.int64()) for k in (0, 1)], ["a", "b"])


def _range_join(near: int, columns: int):
    """Over rows sorted by their first `columns` columns, then fp: the links within each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the cell that is still open
        key, pending, waiting = None, [], 0

        def flush():
            nonlocal pending, waiting
            if pending:
                starts = np.concatenate(([0], np.cumsum([len(x) for x in pending])))
                stars = _forest(_links_in_runs(np.concatenate(pending), starts, near))
                pending, waiting = [], 0
                if stars.num_rows:
                    yield stars

        def close():
            nonlocal held, waiting
            n = sum(map(len, held))
            if n > 1:
                pending.append(np.concatenate(held) if len(held) > 1 else held[0])
                waiting += n
            held = []
            if waiting >= 1 << 16:
                yield from flush()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
            fp = batch.column(columns).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            change = np.zeros(len(fp), bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            starts = np.concatenate(([0], np.flatnonzero(change), [len(fp)]))
            size = np.diff(starts)
            for r in np.flatnonzero((size > 1) | (np.arange(len(size)) == 0) | (np.arange(len(size)) == len(size) - 1)):
                here = tuple(k[starts[r]] for k in keys)
                if here != key:
                    yield from close()
                    key = here
                held.append(fp[starts[r] : starts[r + 1]])
        yield from close()
        yield from flush()

    return run


def _compared(cells: DataFrame, near: int, *keys: str) -> DataFrame:
    """Links (a, b) within the groups of cells by keys."""
    dealt = cells.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys, "fp")
    return dealt.mapInArrow(_range_join(near, len(keys)), "a long, b long")


def links(distinct: DataFrame, scratch: Scratch, near: int = NEAR, blocks: int = BLOCKS, limit: int = CELL_LIMIT, block: int = CELL_BLOCK) -> DataFrame:
    """Links (a, b) among distinct fingerprints that span every component at distance near."""
    cells = distinct.select("fp").mapInArrow(_cells(near, blocks), "plane short, cell long, fp long")
    sizes = cells.groupBy("plane", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    large = scratch.write(sizes.select("plane", "cell", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    if large.isEmpty():
        return _compared(cells, near, "plane", "cell")
    cells = salted_join(cells, large, ["plane", "cell"], "left")
    split = cells.filter("parts is not null").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    return _compared(cells.filter("parts is null"), near, "plane", "cell").unionAll(_compared(split, near, "plane", "cell", "i", "j"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root (the smallest node of its component) for every node of edges (a, b)."""

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        both = salted_join(pairs, least, ["a"], "inner")
        if large:
            both = both.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            both = both.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        return both.filter("a <> b").distinct()

    edges = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        ways = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        once = scratch.write(stars(ways, True))
        after = scratch.write(stars(once, False))
        scratch.drop(edges, once)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)


def classes(fps: DataFrame, scratch: Scratch, near: int = NEAR) -> DataFrame:
    """fp, n (its rows), first (their smallest doc_id), root (the fingerprint that names its
    component) and least (the component's smallest doc_id) for each distinct fp of fps (doc_id, fp)."""
    distinct = scratch.write(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")))
    nodes = components(links(distinct, scratch, near), scratch)
    rooted = distinct.join(nodes, distinct.fp == nodes.node, "left").drop("node")
    linked = scratch.write(rooted.filter("root is not null"))
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    alone = rooted.filter("root is null").select("fp", "n", "first", F.col("fp").alias("root"), F.col("first").alias("least"))
    return alone.unionAll(salted_join(linked, least, ["root"], "left").select("fp", "n", "first", "root", "least"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near: int = NEAR) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, and of rows with that id one."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text)).alias("fp"))
    rows = scratch.write(rows.withColumn("rid", F.monotonically_increasing_id()))
    found = scratch.write(classes(rows.select("doc_id", "fp"), scratch, near))
    size = found.groupBy("root").agg(F.sum("n").alias("members"))
    several = salted_join(found.select("fp", "root"), size.filter("members > 1"), ["root"], "inner").select("fp", "root")
    of = salted_join(rows.select("doc_id", "rid", "fp"), several, ["fp"], "inner")
    best = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("best"))
    gone = salted_join(of, best, ["root"], "inner").filter(F.col("rid") != F.col("best.rid")).select("rid")
    return rows.join(gone, "rid", "left_anti").select("row.*")


def op8_simhash(spark, sf_dir):
    scratch = Scratch(spark, "simhash")
    fps = scratch.write(documents(spark, sf_dir).select("doc_id", fingerprint_column(F.col("text")).alias("fp")))
    found = scratch.write(classes(fps, scratch))
    once = found.filter("n = 1").select(F.col("first").alias("doc_id"), "fp", "least")
    many = salted_join(fps, found.filter("n > 1"), ["fp"], "inner").select("doc_id", "fp", "least")
    return once.unionAll(many).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))
