from collections import defaultdict

from quern.llm.exact_dedup import drop_copies, op9_exact_dedup, radix_groups


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    by = defaultdict(list)
    for d in docs:
        by[d.text or ""].append(d.doc_id)
    got = op9_exact_dedup(spark, sf_dir).collect()
    assert len(got) == len(docs)
    text = {d.doc_id: d.text or "" for d in docs}
    for x in got:
        same = by[text[x.doc_id]]
        assert (x.keep_id, x.group_size, x.kept) == (max(same), len(same), x.doc_id == max(same))


def test_prefixes_ends_nulls_and_repeated_rows(spark):
    long = "x" * 64
    texts = [None, "", "", "a", "a", "ab", long, long, long + "y", long + "y", long + "z", long * 40, long * 40, long * 40 + "é", "é", "é"]
    rows = [(i, t, 7, "k") for i, t in enumerate(texts)] + [(5, "same", 1, None), (5, "same", 1, None), (None, "same", 1, None), (None, "lone", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gid int, run string")
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((str(x.doc_id), x.text or "") for x in kept.collect()) == sorted(
        [("2", ""), ("4", "a"), ("5", "ab"), ("7", long), ("9", long + "y"), ("10", long + "z"), ("12", long * 40), ("13", long * 40 + "é"), ("14", "é"), ("15", "é"), ("5", "same"), ("None", "lone")]
    )
    assert drop_copies(docs.limit(0)).count() == 0


def test_large_group_of_copies(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('hot ', 500), concat('t', id)) as text")
    got = radix_groups(docs, "doc_id", "text", [docs.text])
    assert {(x.keep_id, x.group_size) for x in got.filter("group_size > 1").collect()} == {(2997, 1000)}
    assert got.count() == 3000 and got.filter("kept").count() == 2001
