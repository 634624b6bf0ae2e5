import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm._shared import Scratch, n_words, salted_join, words
from quern.llm._spans import any_case, prefix_sums, spans
from quern.llm.bpe import default_path, encoder
from tokenizers import Tokenizer

LIBRARY = Tokenizer.from_file(default_path())


def test_spans_and_prefix_sums(spark):
    r = random.Random(1)
    texts = ["".join(r.choices("ab1 é🏴\n", k=r.randrange(60))) for _ in range(200)] + ["", "ab" * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: x.s for x in rows.select("i", spans(F.col("t"), "a(b*)1?", 1).alias("s")).collect()}
    for i, t in enumerate(texts):
        want = [(m.start(), m.end(), m[0], m[1]) for m in re.finditer("a(b*)1?", t)]
        assert [tuple(x) for x in got[i] or []] == want
    for n in (1, 2, 7, 100):
        a = [r.randrange(9) for _ in range(n)]
        assert spark.createDataFrame([(a,)], "a array<int>").select(prefix_sums(F.col("a")).alias("s")).first().s == [sum(a[: k + 1]) for k in range(n)]
    assert re.fullmatch(any_case("api_?key"), "aPIkEy") and not re.fullmatch(any_case("key"), "Key")


def test_salted_join_with_null_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else i % 2) for i in range(60)], "id int, k int")
    few = spark.createDataFrame([(None, "none"), (0, "even")], "k int, v string")
    got = {x.id: x.v for x in salted_join(rows, few, ["k"], "left").collect()}
    assert got == {i: "none" if i % 3 else "even" if i % 2 == 0 else None for i in range(60)}


def test_words(spark):
    texts = [None, "", " \t", "a", " a\x0bb\x0c\rc ", "   x\x1cy"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", words(F.col("t")).alias("w"), n_words(F.col("t")).alias("n"))
    for x in rows.collect():
        want = re.findall(r"[^\x20\x09-\x0D]+", texts[x.i] or "")
        assert x.w == want and x.n == len(want)


def test_scratch_tables_can_be_dropped(spark):
    scratch = Scratch(spark, "t")
    a, b = scratch.write(spark.range(5)), scratch.write(spark.range(7))
    scratch.drop(a)
    assert b.count() == 7 and not [f for f in b.inputFiles() if f"{scratch.path}/1/" in f]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_as_in_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    ids = encoder(default_path()).encode_all([text])[0]
    assert ids == " ".join(map(str, want)).encode()
    assert encoder(default_path()).decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)
