import hashlib
import random

from tokenizers import Tokenizer

from quern.llm.bpe import bpe, default_path, encode_documents, encoder, op2_bpe
from pyspark.sql import functions as F


def check(library, text, ids):
    want = library.encode(text or "", add_special_tokens=False).ids
    assert ids == " ".join(map(str, want)).encode()
    assert encoder(default_path()).decode(ids) == library.decode(want, skip_special_tokens=False)


def test_matches_library():
    library, own, r = Tokenizer.from_file(default_path()), encoder(default_path()), random.Random(2)
    alphabet = [*range(33, 127), *[32] * 20, 9, 10, 0x85, 0xA0, 0x301, 0x327, 0x130, 0x3A3, 0x2009, *range(0xC0, 0x250), *range(0x4E00, 0x4E40), *range(0x1F600, 0x1F640), *range(0xAC00, 0xAC20)]
    texts = [None, "", "  \n", "aaaa" * 500, "<|endoftext|>", "x<|startoftext|><|endoftext|>y <|endoftext", "Don't YOU'LL we'Re 's'", "ab\x1cd \x00e", "word " * 20_000]
    texts += ["".join(chr(r.choice(alphabet)) for _ in range(300)) for _ in range(300)]
    texts += ["".join(r.choice("ehinorst ") for _ in range(400)) for _ in range(50)]
    for text, ids in zip(texts, own.encode_all(texts)):
        check(library, text, ids)


def test_query_matches_library(spark, sf_dir):
    library = Tokenizer.from_file(default_path())
    text = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op2_bpe(spark, sf_dir).collect()
    assert len(rows) == len(text)
    for x in rows:
        ids = library.encode(text[x.doc_id], add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 2), (None, "", 2), (3, "hi", 2), (3, "hi", 2)], "doc_id long, text string, b int")
    assert sorted((str(x.doc_id), x.n_tokens) for x in encode_documents(docs, default_path()).collect()) == [("1", 0), ("3", 1), ("3", 1), ("None", 0)]
    assert encode_documents(docs.limit(0), default_path()).count() == 0
    got = docs.filter("text = 'hi'").select(bpe(F.col("text"), default_path(), texts=True).alias("r")).first().r
    assert (got.ids, got.decoded) == ([int(encoder(default_path()).words["hi"])], "hi</w>")


def test_full_cache(monkeypatch):
    library, own = Tokenizer.from_file(default_path()), encoder(default_path())
    monkeypatch.setattr("quern.llm.bpe.CACHE", 5)
    for texts in (["one two three four five six", "seven one"], ["six seven eight nine ten", "one ten"], ["one two", "eight six"]):
        for text, ids in zip(texts, own.encode_all(texts)):
            check(library, text, ids)
