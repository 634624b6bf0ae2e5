"""Substring dedup by level-wise doubling.

The ladder's lengths double up to the window: 9, 18 and 35 words for windows of 35 (the last
doubling is capped, as longer repeats remove no more words). Windows that are repeated at one
length alone are extended to the next; a length without survivors ends the ladder.

Below the last length a sample of windows stands for all. It is chosen by content: each target
window chooses its 18 words of least hash, and these their 9 words of least hash. Equal windows
choose alike, so a target window whose choice is unique cannot be repeated, and a tenth of all
positions is counted. The last length counts every surviving window by 96-bit hashes. A word
sequence that whole documents share is counted once, with weight two.

One pass over the texts writes the samples of all lengths, so that the lower lengths are joins of
small rows. Texts and what survives then meet sorted by document, and are read as streams: a
task holds one batch and one document's windows, never a group. Counts are pre-aggregated before
the shuffle; survivors go back over joins whose long side is split where a key is hot.

Null, empty and blank texts have no words. Rows with one id are separate documents; identical
rows repeat each other. Ids may be of any type, and null. An empty table gives an empty result.
Texts of any length are read whole. Only the id and text columns are read, so other columns
cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, documents, salted_join

WINDOW = 35
#: No length below it is halved.
SHORTEST = 16
BASE = 0x9E3779B97F4A7C15  # odd, so that no word of a window loses weight
#: Words that are hashed together, and rows that are passed on together.
TOGETHER, ROWS = 1 << 16, 1 << 16


def ladder(window: int) -> list[int]:
    """Lengths that double up to window; two at least."""
    rungs = [(window + 1) // 2, window]
    while rungs[0] >= SHORTEST:
        rungs.insert(0, (rungs[0] + 1) // 2)
    return rungs


def lanes_of(words: list[bytes]) -> np.ndarray:
    """Two rows: the halves of each word's 128-bit hash."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2).T.copy()


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of every n consecutive entries, doubling the length at each step."""
    out, length, done = None, 0, h
    while n:
        if n & 1:
            if out is None:
                out, length = done, n_of(done, h)
            else:
                size = n_of(done, h)
                keep = len(h) - length - size + 1
                out = out[:keep] * np.uint64(pow(BASE, size, 1 << 64)) + done[length : length + keep]
                length += size
        n >>= 1
        if n:
            size = n_of(done, h)
            power = np.uint64(pow(BASE, size, 1 << 64))
            done = done[:-size] * power + done[size:]
    return out


def n_of(hashes: np.ndarray, h: np.ndarray) -> int:
    return len(h) - len(hashes) + 1


def _sliding(a: np.ndarray, n: int, f) -> np.ndarray:
    """f over every n consecutive entries, by doubling."""
    out, k = a, 1
    while 2 * k <= n:
        out, k = f(out[:-k], out[k:]), 2 * k
    return f(out[: len(out) - (n - k)], out[n - k :]) if k < n else out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def choices(lane: np.ndarray, of: np.ndarray, rungs: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For every target window the hash of its choice, and whether it lies within one document.

    lane: words of documents one after another; of: each word's document.
    """
    k = _mixed(window_hash(lane, rungs[-2]))
    least = _sliding(k, rungs[-1] - rungs[-2] + 1, np.minimum)
    return least, of[rungs[-1] - 1 :] == of[: len(least)]


def samples(lane: np.ndarray, of: np.ndarray, rungs: list[int]) -> list[np.ndarray]:
    """document, then hash and weight for each length but the last, of the windows chosen.

    A row for each distinct chosen window of the longest of these lengths. The weight is the
    number of places in the document, 2 at most, and stands on one row of each hash.
    """
    least, whole = choices(lane, of, rungs)
    k, edge = _mixed(window_hash(lane, rungs[-2])), np.zeros(rungs[-1] - rungs[-2], np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, np.where(whole, least, 0).astype(np.uint64), edge]), len(edge) + 1, np.maximum) == k)
    places, values = [at], [k[at]]
    for long, short in zip(rungs[-2:0:-1], rungs[-3::-1]):
        k = _mixed(window_hash(lane, short))
        at = at + k[at[:, None] + np.arange(long - short + 1)].argmin(axis=1)
        places.insert(0, at)
        values.insert(0, k[at])
    doc = of[places[-1]]
    order = np.lexsort((values[-1], doc))
    kept = np.zeros(len(doc), bool)
    kept[order[_starts(doc[order], values[-1][order])]] = True
    out = [doc[kept]]
    for place, value in zip(places, values):
        order = np.lexsort((place, value, doc))
        starts = _starts(doc[order], value[order])
        n = np.add.reduceat(_starts(doc[order], place[order], flags=True).astype(np.int32), starts) if len(starts) else starts
        first = np.minimum.reduceat(np.where(kept[order], np.arange(len(order)), len(order) - 1), starts) if len(starts) else starts
        weight = np.zeros(len(doc), np.int32)
        weight[order[first]] = np.minimum(n, 2)
        out += [value[kept], weight[kept]]
    return out


def _starts(*columns: np.ndarray, flags: bool = False) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new if flags else np.flatnonzero(new)


def _sequence(words: list[bytes]) -> tuple[int, int]:
    """128 bits for the whole word sequence, as two signed longs."""
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _texts(column: pa.Array, at: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """(place in column, words) of the texts at `at`."""
    for i in range(0, len(at), 64):
        for place, text in zip(at[i : i + 64].tolist(), column.take(pa.array(at[i : i + 64])).to_pylist()):
            yield place, _split(text)


def _together(docs: Iterator[tuple[int, list[bytes]]]) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Documents in lists of about TOGETHER words; a longer one is alone."""
    held, n = [], 0
    for doc in docs:
        if held and n + len(doc[1]) > TOGETHER:
            yield held
            held, n = [], 0
        held.append(doc)
        n += len(doc[1])
    if held:
        yield held


def _joined(docs: list[tuple[int, list[bytes]]]) -> tuple[np.ndarray, np.ndarray]:
    """The lanes of the words of all docs, and each word's place in docs."""
    return lanes_of([w for _, words in docs for w in words]), np.repeat(np.arange(len(docs)), [len(words) for _, words in docs])


def _marks(rungs: list[int]):
    """k, and of each document of `window` words or more its sequence (hi, lo) and its samples."""
    names = ["k", "hi", "lo", *[f"{x}{j}" for j in range(len(rungs) - 1) for x in "hn"]]

    def batch(k: np.ndarray, sequence: list[tuple[int, int]] | None, rest: list[np.ndarray] | None) -> pa.RecordBatch:
        two = [pa.array([s[i] for s in sequence], pa.int64()) for i in (0, 1)] if sequence else [pa.nulls(len(k), pa.int64())] * 2
        more = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in rest] if rest else [pa.nulls(len(k), pa.int64() if n[0] == "h" else pa.int32()) for n in names[3:]]
        return pa.RecordBatch.from_arrays([pa.array(k), *two, *more], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys = rows.column(0).to_numpy()
            long = (d for d in _texts(rows.column(1), np.arange(rows.num_rows)) if len(d[1]) >= rungs[-1])
            for docs in _together(long):
                k = keys[[i for i, _ in docs]]
                yield batch(k, [_sequence(words) for _, words in docs], None)
                lanes, of = _joined(docs)
                doc, *rest = samples(lanes[0], of, rungs)
                for i in range(0, len(doc), ROWS):
                    yield batch(k[doc[i : i + ROWS]], None, [x[i : i + ROWS] for x in rest])

    return run, "k long, hi long, lo long" + "".join(f", h{j} long, n{j} int" for j in range(len(rungs) - 1))


def _result(w: list[bytes], starts: np.ndarray, window: int, digest: bool) -> tuple[int, int, str]:
    """n_words, n_removed and what remains of w when the windows at starts are removed."""
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = b" ".join([x for x, g in zip(w, gone.tolist()) if not g] if len(starts) else w)
    return len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest() if digest else kept.decode()


FIRST, COPY, CHOSEN, TEXT = range(4)
RESULT = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]
COUNTED = [("rid", pa.int64()), ("p", pa.int32()), ("h", pa.int64()), ("g", pa.int32()), ("n", pa.int32())]


def _record(n: int, fields: list, given: dict) -> pa.RecordBatch:
    """n rows of fields; null where nothing is given."""
    arrays = [given[name] if name in given else pa.nulls(n, kind) for name, kind in fields]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _decided(ids: pa.Array, found: list[tuple[int, tuple[int, int, str]]], fields: list) -> pa.RecordBatch:
    columns = {name: pa.array([r[j] for _, r in found], kind) for j, (name, kind) in enumerate(RESULT)}
    return _record(len(found), fields, columns | {"doc_id": ids.take(pa.array([i for i, _ in found], pa.int64()))})


def _windows(rungs: list[int], digest: bool):
    """Over rows (k, kind, a, b, doc_id, text) sorted by k, then kind: what reached a document
    before its text. Results where the lower lengths decide; else the text under a number rid, and
    of each surviving window rid, place, hash and weight."""
    window = rungs[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        keys, known = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        copies: dict[int, list[tuple[int, int, int]]] = {}
        for rows in batches:
            if not rows.num_rows:
                continue
            k, kind, a, b = (rows.column(i).to_numpy() for i in range(4))
            ids, texts = rows.column(4), rows.column(5)
            fields = [("doc_id", ids.type), *COUNTED, ("text", pa.string()), *RESULT]
            before, chosen = keys == k[0], kind == CHOSEN
            keys, known = np.concatenate([keys[before], k[chosen]]), np.concatenate([known[before], a[chosen].view(np.uint64)])
            copies = {x: y for x, y in copies.items() if x == k[0]}
            for i in np.flatnonzero(kind <= COPY).tolist():
                copies.setdefault(int(k[i]), []).append((int(a[i]), int(b[i]), int(kind[i])))
            repeated = np.unique(known)
            here = np.flatnonzero(kind == TEXT)
            met = set(here[np.isin(k[here], keys)].tolist())
            for docs in _together(_texts(texts, here)):
                found, counted, first = [], [], set()
                for i, w in docs:
                    same = copies.get(int(k[i])) if len(w) >= window else None
                    role = next((c[2] for c in same if c[:2] == _sequence(w)), None) if same else None
                    if role is not None:
                        found.append((i, _result(w, np.arange(len(w) - window + 1), window, digest)))
                    if role == FIRST:
                        first.add(len(counted))
                    if role == FIRST or role is None and len(w) >= window and i in met:
                        counted.append((i, w))
                    elif role is None:
                        found.append((i, _result(w, np.zeros(0, np.int64), window, digest)))
                if counted:
                    lanes, of = _joined(counted)
                    least, whole = choices(lanes[0], of, rungs)
                    where = np.minimum(np.searchsorted(repeated, least), max(len(repeated) - 1, 0))
                    at = np.flatnonzero(whole & (repeated[where] == least)) if len(repeated) else np.zeros(0, np.int64)
                    doc = of[at]
                    open_ = sorted(set(doc.tolist()) - first)
                    rids = np.full(len(counted), -1, np.int64)
                    rids[open_] = number + np.arange(len(open_))
                    number += len(open_)
                    found += [(i, _result(w, np.zeros(0, np.int64), window, digest)) for j, (i, w) in enumerate(counted) if rids[j] < 0 and j not in first]
                    begins = np.concatenate([[0], np.cumsum([len(w) for _, w in counted])])
                    weight = np.ones(len(counted), np.int32)
                    weight[sorted(first)] = 2
                    h, g = window_hash(lanes[0], window)[at].view(np.int64), (window_hash(lanes[1], window)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    columns = {"rid": rids[doc], "p": (at - begins[doc]).astype(np.int32), "h": h, "g": g, "n": weight[doc]}
                    for i in range(0, len(at), ROWS):
                        part = {name: pa.array(x[i : i + ROWS]) for name, x in columns.items()}
                        yield _record(len(part["rid"]), fields, part)
                    if open_:
                        where = pa.array([counted[j][0] for j in open_], pa.int64())
                        yield _record(len(open_), fields, {"doc_id": ids.take(where), "rid": pa.array(rids[open_]), "text": texts.take(where)})
                if found:
                    yield _decided(ids, found, fields)

    return run


def _removal(window: int, digest: bool):
    """Over rows (rid, p, doc_id, text) sorted by rid, each text after its places p: results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, places = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for rows in batches:
            if not rows.num_rows:
                continue
            rid, p, ids = rows.column(0).to_numpy(), rows.column(1).to_numpy().astype(np.int64), rows.column(2)
            fields = [("doc_id", ids.type), *RESULT]
            before, now = held == rid[0], p >= 0
            held, places = np.concatenate([held[before], rid[now]]), np.concatenate([places[before], p[now]])
            for docs in _together(_texts(rows.column(3), np.flatnonzero(~now))):
                span = [np.searchsorted(held, rid[[i for i, _ in docs]], side) for side in ("left", "right")]
                yield _decided(ids, [(i, _result(w, places[a:b], window, digest)) for (i, w), a, b in zip(docs, *span)], fields)

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept for each row of docs.

    kept is the text of the words that no repeated window covers, joined by one space, or its
    SHA-256 if digest is set (texts then leave the tables as soon as they are decided).
    """
    scratch, rungs = Scratch(docs.sparkSession, "substring"), ladder(window)
    rows = docs.select(F.xxhash64(F.col(doc_id)).alias("k"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    run, schema = _marks(rungs)
    marks = scratch.write(rows.select("k", "text").mapInArrow(run, schema))
    live, spent = marks.filter("h0 is not null").drop("hi", "lo"), []
    for j in range(len(rungs) - 1):
        h = f"h{j}"
        repeated = scratch.write(live.groupBy(h).agg(F.sum(f"n{j}").alias("n")).filter("n > 1").select(h))
        spent.append(repeated)
        live = live.join(repeated.hint("merge"), h).drop(h, f"n{j}") if j < len(rungs) - 2 else live.select("k", h).join(repeated.hint("merge"), h)
        if repeated.isEmpty():
            live = live.limit(0).withColumn(f"h{len(rungs) - 2}", F.lit(0).cast("long"))
            break
        if j < len(rungs) - 2:
            live = scratch.write(live)
            spent.append(live)
    sequences = marks.filter("hi is not null").select("k", "hi", "lo")
    copies = sequences.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min("k").alias("first")).filter("n > 1")
    same = salted_join(sequences, copies, ["hi", "lo"], "inner")
    part = lambda t, kind_, a, b, id_, body: t.select("k", kind_.cast("byte").alias("kind"), a.alias("a"), b.alias("b"), id_.alias("doc_id"), body.alias("text"))
    nothing, none, no_text = F.lit(0).cast("long"), F.lit(None).cast(kind), F.lit(None).cast("string")
    met = part(same, F.when(F.col("k") == F.col("first"), FIRST).otherwise(COPY), F.col("hi"), F.col("lo"), none, no_text)
    met = met.unionAll(part(live, F.lit(CHOSEN), F.col(f"h{len(rungs) - 2}"), nothing, none, no_text))
    met = met.unionAll(part(rows, F.lit(TEXT), nothing, nothing, F.col("doc_id"), F.col("text")))
    met = met.repartition("k").sortWithinPartitions("k", "kind")
    result = "n_words long, n_removed long, kept string"
    two = scratch.write(met.mapInArrow(_windows(rungs, digest), f"doc_id {kind}, rid long, p int, h long, g int, n int, text string, {result}"))
    scratch.drop(marks, *spent)
    counted = two.filter("h is not null")
    again = scratch.write(counted.groupBy("h", "g").agg(F.sum("n").alias("n")).filter("n > 1").select("h", "g"))
    back = counted.filter("rid >= 0").select("rid", "p", "h", "g").join(again.hint("merge"), ["h", "g"]).select("rid", "p", none.alias("doc_id"), no_text.alias("text"))
    back = back.unionAll(two.filter("text is not null").select("rid", F.lit(-1).alias("p"), "doc_id", "text"))
    back = back.repartition("rid").sortWithinPartitions("rid", F.col("p") < 0)
    last = back.mapInArrow(_removal(window, digest), f"doc_id {kind}, {result}")
    return two.filter("kept is not null").select("doc_id", "n_words", "n_removed", "kept").unionAll(last)


def op1_substring_dedup(spark, sf_dir):
    found = remove_repeats(documents(spark, sf_dir), digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")
