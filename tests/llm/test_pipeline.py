import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm.bpe import default_path
from quern.llm.mixing import Target
from quern.llm.quality_rules import op4_quality_rules

from .test_mixing import brute as brute_mix
from .test_simhash import brute_components, brute_fingerprint


def test_run_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    good = {x.doc_id for x in op4_quality_rules(spark, d).collect() if x.kept}
    docs = [x for x in spark.read.parquet(f"{d}/documents.parquet").collect() if x.doc_id in good]
    last = {x.text: x.doc_id for x in sorted(docs, key=lambda x: x.doc_id)}
    docs = sorted((x for x in docs if last[x.text] == x.doc_id), key=lambda x: x.doc_id)
    root = brute_components(np.array([brute_fingerprint(x.text) for x in docs], np.uint64))
    docs = [x for i, x in enumerate(docs) if root[i] == i]
    copies = brute_mix([(x.doc_id, x.source, len(x.text.encode().split())) for x in docs], Target())
    times = {int(a): int(c) for a, _, c in (s.strip("()").split(", ") for s in copies)}
    library = Tokenizer.from_file(default_path())
    want = sorted((x.doc_id, len(library.encode(x.text, add_special_tokens=False).ids)) for x in docs for _ in range(times[x.doc_id]))
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted((x.doc_id, x.n_tokens) for x in got) == want


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_empty_and_null(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for rows in (docs.limit(0), docs.limit(3).selectExpr(*[f"cast(null as {t}) as {c}" for c, t in docs.dtypes])):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, sf_dir).collect()
