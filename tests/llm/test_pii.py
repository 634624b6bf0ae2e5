import hashlib
import hmac
import os
import re

import pytest

from pyspark.sql import functions as F

from quern.llm import pii
from quern.llm._shared import Scratch

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
TITLE = "(?:" + "|".join(t for ts in pii.TITLES.values() for t in ts) + r")\.? "
PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{1,4}){3,6}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
LETTERS = r"[A-ZÀ-ÞΑ-ΩА-Я][^\W\d_]+"
ANY = re.compile(rf"(?P<email>{EMAIL})|(?P<name>{TITLE}{LETTERS}(?: {LETTERS})?)|(?P<phone>{PHONE})|(?P<ssn>[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}})|(?P<ip>[0-9]+(?:\.[0-9]+)+)|(?P<card>[0-9](?:[ -]?[0-9]){{12,}})")


def kind(m):
    if m.lastgroup == "ip" and not (m[0].count(".") == 3 and all(x == str(int(x)) and int(x) < 256 for x in m[0].split("."))):
        return None
    if m.lastgroup == "card" and not 13 <= len(re.sub(r"\D", "", m[0])) <= 19:
        return None
    if m.lastgroup == "phone" and not 7 <= len(re.sub(r"\D", "", m[0])) <= 15:
        return None
    return m.lastgroup


def canonical(k, m):
    if k == "name":
        g = next((g for g in "fm" if re.match("(?:" + "|".join(pii.TITLES[g]) + ")[. ]", m)), "n")
        return f"{g} " + re.sub(f"^{TITLE}", "", m).lower()
    return m.lower() if k == "email" else m if k == "ip" else re.sub(r"\D", "", m)


SECRET = "a key for tests"


@pytest.fixture(autouse=True)
def keyed(spark):
    spark.conf.set(pii.KEY, SECRET)
    yield
    spark.conf.unset(pii.KEY)


def draw(k, canon, attempt, key=SECRET):
    d = hmac.new(key.encode(), f"{k}|{canon}|{attempt}".encode(), hashlib.sha256).hexdigest()
    byte = lambda i: int(d[i % 31 * 2 : i % 31 * 2 + 2], 16)
    shape = lambda t: "".join(str(byte(i) % 10) if c in "0123456789" else chr(97 + byte(i) % 26) if "a" <= c <= "z" else c for i, c in enumerate(t))
    if k == "email":
        return shape(canon.rpartition(".")[0]) + ".example"
    if k == "name":
        s = "cyrillic" if re.search("[а-яё]", canon[2:]) else "greek" if re.search("[α-ωά-ώ]", canon[2:]) else "latin"
        syllables, ends = pii.SCRIPTS[s]
        made = [syllables[byte(i) % len(syllables)] for i in range(7)]
        female = canon[0] == "f" or canon[0] == "n" and byte(7) % 2 == 0
        return canon[:2] + ("".join(made[4:]) + " " if " " in canon[2:] else "") + "".join(made[:4]) + ends[not female]
    if k == "ip":
        return ".".join(str((byte(2 * i) * 256 + byte(2 * i + 1)) % 254 + 1) for i in range(4))
    if k in ("phone", "ssn"):
        return canon[0] + shape(canon)[1:]
    digits = canon[0] + shape(canon)[1:-1]
    total = sum(int(c) if i % 2 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
    return digits + str(-total % 10)


def lay(k, mention, new):
    if k == "email":
        return "".join(c.upper() if i < len(mention) and "A" <= mention[i] <= "Z" else c for i, c in enumerate(new))
    if k == "name":
        names = re.sub(f"^{TITLE}", "", mention)
        return mention[: len(mention) - len(names)] + (new[2:].upper() if names == names.upper() else new[2:].title())
    digits = iter(new)
    return new if k == "ip" else "".join(next(digits) if c in "0123456789" else c for c in mention)


def brute(texts, draw=draw):
    real = {(kind(m), canonical(kind(m), m[0])) for t in texts for m in ANY.finditer(t or "") if kind(m)}
    seen = lambda k, c: (k, c[2:] if k == "name" else c)
    told = {c[2:]: [d for k, d in real if k == "name" and d[2:] == c[2:] and d[0] != "n"] for k, c in real if k == "name" and c[0] == "n"}
    alias = {("name", f"n {name}"): ("name", ds[0]) for name, ds in told.items() if len(ds) == 1}
    taken, used = {seen(*x) for x in real}, set()
    new, attempt, left = {}, 0, sorted(real - alias.keys())
    while left:
        again = []
        for k, c in left:
            s = draw(k, c, attempt)
            if seen(k, s) in used or seen(k, s) in taken:
                again.append((k, c))
            else:
                new[k, c] = s
                used.add(seen(k, s))
        left, attempt = again, attempt + 1
    new |= {a: new[b] for a, b in alias.items()}
    put = lambda m: lay(kind(m), m[0], new[kind(m), canonical(kind(m), m[0])]) if kind(m) else m[0]
    return [None if t is None else ANY.sub(put, t) for t in texts], new


TEXTS = [
    None, "", "nothing here 12 3.4 1.2.3.4.5 999.1.1.1", "mail Anna.Q7@Mail3.Example.com and anna.q7@mail3.example.com",
    "+1 (679) 555-5221 or 1-679 or +16795555221", "10.0.0.1 10.0.0.2 4111 1111 1111 1111 4111111111111111 12345678901234567890123",
    "Mrs. Smith met Mr Smith, Frau Müller and MR X; Mrs SMITH", "Госпожа Иванова и Господин Иванов; Κύριος Παπάς", "(555) 010-9999\n+49 30 1234 5678é🏴 x@y.z",
    "10.0.0.1 " * 4000, "Dr. Anna Smith and Prof Lee, Frau Anna Smith; ssn 123-45-6789 123456789", "+33 1 42 68 53 00, 555-123-4567 or 555.123.4567",
]


def test_texts_match_brute_force(spark):
    rows = [(i, t, "k", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "k", 1), (None, TEXTS[5], None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kinds string, rid int")
    got = sorted((str(x.row.asDict()), x.text) for x in pii.replace(docs).collect())
    want, new = brute([r[1] for r in rows])
    assert [t for _, t in got] == [t for _, t in sorted((str(dict(zip(docs.columns, r))), t) for r, t in zip(rows, want))]
    assert len(set(new.values())) == len(new) - 1  # Dr. and Frau Anna Smith are one
    assert pii.replace(docs.limit(0)).count() == 0


def test_collisions_are_drawn_again(spark, monkeypatch):
    few = lambda of, canon, attempt, key: pii.F.concat(pii.F.lit("10.0.0."), (pii.F.length(canon) + 20 * attempt).cast("string"))
    monkeypatch.setattr(pii, "surrogate", few)
    texts = [f"10.0.0.{i}" for i in (7, 8, 9, 10, 28, 29)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.row.text: x.text for x in pii.replace(rows).collect()}
    assert len(set(got.values())) == 6 and not set(got.values()) & set(texts)


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    got = {x.doc_id: x for x in pii.op10_pii(spark, d).collect()}
    want, new = brute([x.text for x in docs])
    assert len(got) == len(docs) and len(new) > 50
    for x, t in zip(docs, want):
        kinds = [kind(m) for m in ANY.finditer(x.text or "") if kind(m)]
        assert (got[x.doc_id].text, got[x.doc_id].n_entities, got[x.doc_id].n_email) == (t, len(kinds), kinds.count("email"))


def test_shapes_of_few_values_do_not_run_out(spark):
    """800 addresses of the shape l@l, which has 676 values."""
    rows = [("email", f"a@b.{x}{y}") for x in "abcdefghij" for y in (f"q{i}" for i in range(80))]
    got = pii.surrogates(spark.createDataFrame(rows, "of string, canon string"), Scratch(spark, "pii"), SECRET).collect()
    assert {(r.of, r.canon) for r in got} == set(rows) and len({r.new for r in got}) == len(rows)
    name = pii.surrogate(F.lit("name"), F.lit("f smith"), F.col("n"), SECRET)
    made = [r[0] for r in spark.range(8).select(F.col("id").cast("int").alias("n")).select(name).collect()]
    assert [len(x) for x in made] == [12] * 4 + [14, 16, 18, 20] and all(x.startswith("f ") for x in made)


def test_numbers_of_few_values_do_not_run_out(spark):
    """700 of the 1,000 numbers of three digits, and addresses, grow until all have surrogates."""
    rows = [(k, f"{i:03d}") for k in ("phone", "ssn") for i in range(300, 1000)] + [("card", f"41{i:02d}") for i in range(90)]
    got = pii.surrogates(spark.createDataFrame(rows, "of string, canon string"), Scratch(spark, "pii"), SECRET).collect()
    assert {(r.of, r.canon) for r in got} == set(rows) and len({(r.of, r.new) for r in got}) == len(rows)
    assert not {(r.of, r.new) for r in got} & set(rows)
    made = [r[0] for r in spark.range(6).select(pii.surrogate(F.lit("ip"), F.lit("1.2.3.4"), F.col("id").cast("int"), SECRET)).collect()]
    assert [x.count(".") for x in made[:4]] == [3] * 4 and all(x.startswith("2001:db8:") for x in made[4:])
    # A longer number keeps the mention's shape and adds its digits.
    laid = spark.range(1).select(pii.laid_out(F.lit("phone"), F.lit("+1 (23) 4"), F.lit("987654"))).first()[0]
    assert laid == "+9 (87) 654"


def test_one_person_has_one_surrogate(spark):
    texts = ["Dr. Anna Smith and Ms Anna Smith met", "Dr Kim, Mr Kim and Mrs Kim", "call +1679 or 1679"]
    got = [x.text for x in pii.replace(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("row.i").collect()]
    one, two = re.fullmatch(r"Dr\. (\w+ \w+) and Ms (\w+ \w+) met", got[0]).groups()
    assert one == two and one.endswith("ra")
    assert len(set(re.findall(r"(?:Dr|Mr|Mrs) (\w+)", got[1]))) == 3 and got[2] == texts[2]


def test_key_and_scratch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail a.b@c.org")], "doc_id long, text string")
    message = spark.range(1).select(pii.hmac("k" * 100, F.lit("héllo"))).first()[0]
    assert message == hmac.new(b"k" * 100, "héllo".encode(), hashlib.sha256).hexdigest()
    spark.conf.unset(pii.KEY)
    first, second = (pii.replace(docs).first().text for _ in range(2))
    assert first != second  # random keys
    pii.write_replaced(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().replaced.endswith(".example")
    root = spark.conf.get("spark.checkpoint.dir")
    scratch = Scratch(spark, "pii")
    scratch.write(docs)
    assert os.path.isdir(scratch.path)
    scratch.clear()
    assert not os.path.exists(scratch.path) and scratch.path.startswith(root)
