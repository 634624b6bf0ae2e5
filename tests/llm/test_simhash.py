import random

import numpy as np
import xxhash

from quern.llm import simhash
from quern.llm._shared import Scratch


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    for c in b"\t\n\x0b\x0c\r":
        w = w.replace(bytes([c]), b" ")
    w = [x for x in w.split(b" ") if x]
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, near=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= near) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = sorted(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    fps = np.array([brute_fingerprint(x.text) for x in docs], np.uint64)
    roots = brute_components(fps)
    got = {x.doc_id: x for x in simhash.op8_simhash(spark, d).collect()}
    assert len(got) == len(docs)
    for x, fp, r in zip(docs, fps, roots):
        assert (got[x.doc_id].fingerprint, got[x.doc_id].component_id) == (f"{fp:016x}", docs[r].doc_id)


def test_manhattan_bound_and_planes():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 2000, np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << r.integers(0, 64, 2000, np.uint64)
    assert (np.bitwise_count(simhash.unary(a) ^ simhash.unary(b)) <= np.bitwise_count(a ^ b)).all()
    masks = np.array(simhash.planes(4, 7), np.uint64)
    assert ((simhash.unary(a)[None] & masks[:, None]) == (simhash.unary(b)[None] & masks[:, None])).any(axis=0).all()


def test_dense_cells_in_both_ways(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << r.randrange(40) for _ in range(r.randrange(1, 9))) for b in base for _ in range(700)}
    fps |= {r.getrandbits(64) for _ in range(500)} | {0}
    fps = np.array(sorted(fps), np.uint64)
    want = brute_components(fps)
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for limit, block in ((1 << 15, 1 << 13), (100, 40)):
        scratch = Scratch(spark, "t")
        edges = simhash.links(scratch.write(table), scratch, limit=limit, block=block)
        got = {x.node: x.root for x in simhash.components(edges, scratch).collect()}
        ids = [got.get(x, x) for x in fps.view(np.int64).tolist()]
        assert len(set(ids)) == len(set(want)) == len(set(zip(ids, want)))


def test_edges_of_input(spark):
    rows = [(3, None, 1), (2, "", 1), (1, " \t", 1), (9, "same words here", 2), (9, "same words here", 2), (8, "SAME words\nhere", 2), (None, "alone in the dark night", 3), (4, "é" * 50_000 + " a b c d e", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((str(x.doc_id), x.fp) for x in kept.collect()) == [("1", 1), ("4", 4), ("8", 2), ("None", 3)]
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0
