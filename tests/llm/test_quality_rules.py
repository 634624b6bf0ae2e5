import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quern.llm.quality_rules import keep_good, op4_quality_rules, quality

SCHEMA = "doc_id long, text string, q string, w string"


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
    return *n, n[0] < 50 or 100 * n[4] > 50 * n[0]


def test_counts_match_brute_force(spark):
    r = random.Random(5)
    texts = [None, "", " ", "a", "a b", "a b c", "a a a a", "a b c a b c", "\x0b\x0c", "x\n\nx\n x\nx", "é" * 200_000]
    texts += [" ".join(r.choices("ab c# d| ü\n \n🏴 <x>".split(" "), k=r.randrange(1, 80))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in rows.select("doc_id", quality(F.col("text")).alias("q")).select("doc_id", "q.*").collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute(t), t


def test_every_document_matches_brute_force(spark, sf_dir):
    text = {x.doc_id: x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op4_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(text)
    for x in rows:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute(text[x.doc_id])
        assert not (x.base_failed and x.kept)


def test_keeps_clean_and_drops_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", quality(F.col("text")).alias("q"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = docs.join(labels, "doc_id").select("quality", "q.base_failed", "q.kept").collect()
    clean = [x.kept for x in rows if x.quality and not x.base_failed]
    junk = [x.kept for x in rows if not x.quality]
    assert sum(clean) >= 0.97 * len(clean)
    assert sum(junk) <= 0.5 * len(junk)


def test_edges_and_clashing_columns(spark):
    good = " ".join(f"the of w{i}" for i in range(40))
    rows = spark.createDataFrame([(1, None, "a", "b"), (2, "", None, "b"), (None, good, "a", None), (3, good, "a", "b"), (3, good, "a", "b")], SCHEMA)
    kept = keep_good(rows)
    assert kept.columns == rows.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, rows.filter("text like 'the%'").collect()))
    assert keep_good(rows.limit(0)).count() == 0
