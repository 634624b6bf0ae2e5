import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quern.llm.substring_dedup import ladder, lanes_of, op1_substring_dedup, remove_repeats, samples, window_hash


def brute(texts, window):
    docs = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for w in docs:
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    got = {x.doc_id: x for x in op1_substring_dedup(spark, d).collect()}
    assert len(got) == len(docs)
    for x, (n, gone, kept) in zip(docs, brute([x.text for x in docs], 35)):
        y = got[x.doc_id]
        assert (y.n_words, y.n_removed, y.kept_sha256) == (n, gone, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("window", [2, 5, 8])
def test_short_windows_and_edges(spark, window):
    r = random.Random(window)
    texts = [None, "", " \n", "a " * 50, "b", "a  a a a", *[" ".join(r.choices("abcdefgh", k=r.randrange(60))) for _ in range(60)]]
    texts += texts[-3:] + ["x y z " * 3000]
    rows = [(i % 50 if i % 9 else None, t, "k", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, h int")
    got = remove_repeats(docs, window=window).collect()
    want = [(rows[i][0], n, gone, kept.decode()) for i, (n, gone, kept) in enumerate(brute(texts, window))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert remove_repeats(docs.limit(0), window=window).count() == 0


def test_window_hash():
    h = np.arange(100, dtype=np.uint64) * np.uint64(0x123456789ABCDEF)
    for n in (1, 2, 3, 17, 18, 35, 64, 100):
        got = window_hash(h, n)
        assert len(got) == 101 - n
        want = 0
        for x in h[:n].tolist():
            want = (want * 0x9E3779B97F4A7C15 + x) % (1 << 64)
        assert got[0] == want


def test_ladder_doubles():
    assert ladder(35) == [9, 18, 35] and ladder(2) == [1, 2] and ladder(100) == [13, 25, 50, 100]
    assert all(b <= 2 * a for w in range(2, 200) for a, b in zip(ladder(w), ladder(w)[1:]))


def test_samples_of_equal_windows_are_equal():
    r = random.Random(4)
    shared = [str(r.random()).encode() for _ in range(35)]
    docs = [[str(r.random()).encode() for _ in range(a)] + shared + [str(r.random()).encode() for _ in range(b)] for a, b in ((0, 7), (30, 0), (11, 40))]
    of = np.repeat(np.arange(3), [len(w) for w in docs])
    doc, h0, n0, h1, n1 = samples(lanes_of([x for w in docs for x in w])[0], of, ladder(35))
    for h, n in ((h0, n0), (h1, n1)):
        met = Counter(h[n > 0].tolist())
        assert sum(c == 3 for c in met.values()) >= 1 and max(met.values()) == 3
    assert len(doc) < len(of) / 3


def test_ids_of_text_and_a_ladder_that_ends_early(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(8)] + [None, "short"]
    docs = spark.createDataFrame([(f"id{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = {x.doc_id: x for x in remove_repeats(docs).collect()}
    assert {k: x.n_removed for k, x in got.items()} == dict.fromkeys((f"id{i}" for i in range(10)), 0)
    assert got["id3"].kept == texts[3] and got["id8"].kept == ""
