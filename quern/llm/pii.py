"""PII surrogates, in column expressions alone.

Detected entities (e-mail addresses, phone numbers of 7 to 15 digits, social security numbers, IPv4
addresses, payment cards, names after a title) are replaced by keyed surrogates of the same kind
and shape: a digit becomes a digit and a letter a letter, separators and letter case stay, cards
pass the Luhn check, octets are octets, and a name keeps its title, script and gender ending.
E-mail addresses end in the reserved domain `example`. A name without a title stays.

Mentions of one entity share a canonical form (case and separators aside), and a surrogate is an
HMAC of key, kind and canonical form, so coreference holds across the corpus. A name after a title
of no gender (Dr, Prof) is the person of that name whose title has one, where the corpus has one
gender for it. Surrogates are checked against each other and against all real entities; what
collides is drawn again with the next attempt number until nothing does, so distinct entities stay
distinct. After TRIES attempts every kind grows by a letter, syllable or digit an attempt, first
digits are drawn too, and addresses become documentation IPv6: the values then outnumber any finite
set of entities, so the rounds end. Only distinct entities enter the check, pre-aggregated;
surrogates go back to mentions over salted keys, as a hot entity may be in a third of all
documents. Texts without entities are never shuffled.

The key is the session's `spark.quern.pii.key`; where it is unset a random one serves for one run.
Scratch tables hold texts in clear: `write_replaced` writes a result and deletes them.

Null text stays null and empty text empty. Rows with one id, and repeated rows, are rewritten
each. An empty table gives an empty result. The input's other columns are carried in a struct,
so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import secrets as random_secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch, documents, let, salted_join

KEY = "spark.quern.pii.key"
#: Attempts at the usual length; each one after lengthens the surrogate.
TRIES = 4

#: Titles by gender.
TITLES = {
    "f": "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Госпожа|Κυρία".split("|"),
    "m": "Mr|Herr|Señor|Sr|Monsieur|Господин|Κύριος".split("|"),
    "n": "Dr|Prof".split("|"),
}
#: Syllables and endings (feminine, masculine) by script.
SCRIPTS = {
    "latin": ("ba ce do fi gu la me no pi ru sa te vo wi zu ka".split(), ("ra", "ron")),
    "cyrillic": ("ба ве до фи гу ла ме но пи ру са те во ми зу ка".split(), ("рова", "ров")),
    "greek": ("βα γε δο φι γου λα με νο πι ρου σα τε βο μι ζου κα".split(), ("ρα", "ρος")),
}

# Possessive, and each group behind a look at its first character: most places fail at once.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
TITLE = r"(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.? "
NAME = "(?=[" + "".join(sorted({t[0] for ts in TITLES.values() for t in ts})) + "])" + TITLE + r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?"
PHONE = "|".join(
    (
        r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}",
        r"\+[0-9]{1,3}(?:[ .-]?[0-9]{1,4}){3,6}",
        r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}",
        r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}",
    )
)
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
DOTTED = r"[0-9]+(?:\.[0-9]+)+"
CARD = r"[0-9](?:[ -]?[0-9]){12,}"
REST = f"{NAME}|(?=[+(0-9])(?:{PHONE}|{SSN}|{DOTTED}|{CARD})"
ANY = f"{EMAIL}|{REST}"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _matching(text: Column, f) -> Column:
    """f(pattern) for the pattern that a text needs: without an at sign none is an e-mail address."""
    return F.when(text.contains("@"), f(ANY)).otherwise(f(REST))


def kind(mention: Column) -> Column:
    """email, name, phone, ssn, ip or card; null for what only looks like one, which stays."""
    digits = F.length(F.regexp_replace(mention, "[^0-9]", ""))
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.rlike(rf"^{NAME}$"), "name")
        .when(mention.rlike(rf"^(?:{PHONE})$"), F.when(digits.between(7, 15), "phone"))
        .when(mention.rlike(rf"^{SSN}$"), "ssn")
        .when(mention.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"), "ip")
        .when(mention.rlike(rf"^{CARD}$") & digits.between(13, 19), "card")
    )


def _after_title(mention: Column) -> Column:
    return F.regexp_replace(mention, f"^{TITLE}", "")


def _gender(mention: Column) -> Column:
    out = F.lit("n ")
    for g in "fm":
        out = F.when(mention.rlike("^(?:" + "|".join(TITLES[g]) + ")[. ]"), f"{g} ").otherwise(out)
    return out


def canonical(of: Column, mention: Column) -> Column:
    return (
        F.when(of == "email", F.lower(mention))
        .when(of == "name", F.concat(_gender(mention), F.lower(_after_title(mention))))
        .when(of == "ip", mention)
        .otherwise(F.regexp_replace(mention, "[^0-9]", ""))
    )


def _byte(digest: Column, i) -> Column:
    """A keyed number from 0 to 255 for place i."""
    return F.conv(F.substring(digest, F.pmod(i, F.lit(31)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))


def _places(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _shape(text: Column, digest: Column) -> Column:
    """text with its letters and digits replaced by keyed ones."""
    made = F.transform(
        _places(text),
        lambda c, i: F.when(c.rlike("[0-9]"), _letter("0123456789", _byte(digest, i))).when(c.rlike("[a-z]"), _letter("abcdefghijklmnopqrstuvwxyz", _byte(digest, i))).otherwise(c),
    )
    return F.array_join(made, "")


def _luhn(digits: Column) -> Column:
    """digits, all but the last of a card, with the check digit."""
    doubled = F.transform(F.reverse(_places(digits)), lambda c, i: F.when(i % 2 == 0, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5)).otherwise(c.cast("int")).cast("int"))
    return F.concat(digits, F.pmod(F.lit(10) - F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10, F.lit(10)).cast("string"))


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _name(canon: Column, digest: Column, longer: Column) -> Column:
    """One made name for each of the entity's; the last has the ending of the gender, and as many
    syllables more as longer says."""
    script, out = _script(F.substring(canon, 3, 1 << 30)), F.lit(None).cast("string")
    for s, (syllables, (f, m)) in SCRIPTS.items():
        made = [F.element_at(F.array(*map(F.lit, syllables)), F.pmod(_byte(digest, F.lit(i)), F.lit(len(syllables))) + 1) for i in range(7)]
        female = canon.startswith("f") | (canon.startswith("n") & (_byte(digest, F.lit(7)) % 2 == 0))
        more = F.transform(F.array_repeat(F.lit(0), longer), lambda _, i: F.element_at(F.array(*map(F.lit, syllables)), F.pmod(_byte(F.reverse(digest), i), F.lit(len(syllables))) + 1))
        last = F.concat(*made[:4], F.array_join(more, ""), F.when(female, f).otherwise(m))
        out = F.when(script == s, F.when(F.substring(canon, 3, 1 << 30).contains(" "), F.concat(*made[4:], F.lit(" "), last)).otherwise(last)).otherwise(out)
    return F.concat(F.substring(canon, 1, 2), out)


def hmac(key: str, message: Column) -> Column:
    """HMAC-SHA256 in hex, of standard construction."""
    k = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    inner, outer = (F.lit(bytes(b ^ x for b in k.ljust(64, b"\0"))) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY, None) or random_secrets.token_hex(32)


def visible(of: Column, canon: Column) -> Column:
    """What a reader sees of a canonical form: not a name's gender."""
    return F.when(of == "name", F.substring(canon, 3, 1 << 30)).otherwise(canon)


def surrogate(of: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form of the replacement of a canonical form."""

    longer = F.greatest(attempt - (TRIES - 1), F.lit(0))

    def made(d: Column) -> Column:
        stem = F.regexp_replace(canon, r"\.[^.]*$", "")
        octets = F.array_join(F.array(*[(F.pmod(_byte(d, F.lit(2 * i)) * 256 + _byte(d, F.lit(2 * i + 1)), F.lit(254)) + 1).cast("string") for i in range(4)]), ".")
        shape, more = _shape(canon, d), _shape(F.repeat(F.lit("0"), longer), F.reverse(d))
        first, rest = F.substring(F.when(longer == 0, canon).otherwise(shape), 1, 1), F.length(canon)
        card = _luhn(F.concat(first, F.substring(shape, F.lit(2), rest - 2), more))
        phone = F.concat(first, F.substring(shape, F.lit(2), rest), more)
        octets = F.when(longer == 0, octets).otherwise(F.concat_ws(":", F.lit("2001:db8"), *[F.substring(d, 4 * i + 1, 4) for i in range(6)]))
        return (
            F.when(of == "email", F.concat(_shape(F.repeat(F.lit("a"), longer), F.reverse(d)), _shape(stem, d), F.lit(".example")))
            .when(of == "name", _name(canon, d, longer))
            .when(of == "ip", octets)
            .when(of == "card", card)
            .otherwise(phone)
        )

    return let(hmac(key, F.concat_ws("|", of, canon, attempt)), made)


def laid_out(of: Column, mention: Column, new: Column) -> Column:
    """A surrogate's canonical form in the shape of a mention."""

    def onto(old: Column, digits: Column) -> Column:
        before = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), "[^0-9]", ""))
        put = F.transform(old, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, before(i) + 1, F.lit(1))).otherwise(c))
        return F.concat(F.array_join(put, ""), F.substring(digits, F.length(F.regexp_replace(mention, "[^0-9]", "")) + 1, F.length(digits)))

    def cased(old: Column, fresh: Column) -> Column:
        return F.array_join(F.transform(fresh, lambda c, i: F.when(F.coalesce(F.get(old, i), F.lit("")).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")

    names = _after_title(mention)
    title = F.substring(mention, F.lit(1), F.length(mention) - F.length(names))
    fresh = F.substring(new, 3, 1 << 30)
    whole = F.when(names == F.upper(names), F.upper(fresh)).otherwise(F.initcap(fresh))
    return (
        F.when(of == "email", let(_places(mention), lambda o: let(_places(new), lambda f: cased(o, f))))
        .when(of == "name", F.concat(title, whole))
        .when(of == "ip", new)
        .otherwise(let(_places(mention), lambda o: onto(o, new)))
    )


def surrogates(entities: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """of, canon and new for each distinct row of entities (of, canon); new values are distinct to
    a reader from each other and from every canon of their kind."""
    real = scratch.write(entities.distinct())
    named = real.filter("of = 'name'").withColumn("name", F.substring("canon", 3, 1 << 30))
    told = named.filter(~F.col("canon").startswith("n ")).groupBy("name").agg(F.count("*").alias("k"), F.min("canon").alias("person")).filter("k = 1")
    same = scratch.write(named.filter(F.col("canon").startswith("n ")).join(told.hint("merge"), "name").select("of", "canon", "person"))
    open_, done, attempt = real.join(same.select("of", "canon").hint("merge"), ["of", "canon"], "left_anti"), None, 0
    seen = F.col("seen")
    taken = real.select("of", visible(F.col("of"), F.col("canon")).alias("seen"), F.lit(True).alias("taken")).distinct()
    while True:
        drawn = open_.withColumn("new", surrogate(F.col("of"), F.col("canon"), F.lit(attempt), key)).withColumn("attempt", F.lit(attempt))
        every = drawn if done is None else done.unionAll(drawn)
        every = every.withColumn("seen", visible(F.col("of"), F.col("new")))
        rank = F.row_number().over(Window.partitionBy("of", seen).orderBy("attempt", "canon"))
        every = every.withColumn("rank", rank).join(taken.hint("merge"), ["of", "seen"], "left")
        every = scratch.write(every.withColumn("free", (F.col("rank") == 1) & F.col("taken").isNull()).select("of", "canon", "new", "attempt", "free"))
        done = every.filter("free").drop("free")
        open_ = every.filter("not free").select("of", "canon")
        if open_.isEmpty():
            found = done.select("of", "canon", "new")
            alike = same.join(found.withColumnRenamed("canon", "person").hint("merge"), ["of", "person"]).select("of", "canon", "new")
            return found.unionAll(alike)
        attempt += 1


def replace(docs: DataFrame, text: str = "text", key: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """row (struct of the columns of docs), text with surrogates, and kinds, an array of the
    entities' kinds in order, for each row of docs."""
    scratch, key = scratch or Scratch(docs.sparkSession, "pii"), key or key_of(docs.sparkSession)
    body = F.col(text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), body.alias("text"))
    has = _matching(F.coalesce(F.col("text"), F.lit("")), lambda p: F.coalesce(F.col("text"), F.lit("")).rlike(p))
    plain = rows.filter(~has).withColumn("kinds", F.array().cast("array<string>"))
    some = rows.filter(has)
    found = _matching(F.col("text"), lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    mentions = F.transform(found, lambda m: let(kind(m), lambda k: F.struct(k.alias("of"), canonical(k, m).alias("canon"), m.alias("mention"))))
    some = scratch.write(some.withColumn("mentions", mentions).withColumn("rid", F.monotonically_increasing_id()))
    each = some.select("rid", F.posexplode("mentions").alias("i", "m")).select("rid", "i", "m.*")
    real, other = each.filter("of is not null"), each.filter("of is null")
    fresh = surrogates(real.select("of", "canon"), scratch, key)
    drawn = salted_join(real, fresh, ["of", "canon"], "inner").select("rid", "i", laid_out(F.col("of"), F.col("mention"), F.col("new")).alias("put"))
    every = drawn.unionAll(other.select("rid", "i", F.col("mention").alias("put")))
    by_row = every.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("i", "put"))).alias("put"))
    joined = some.join(by_row.withColumnRenamed("rid", "of_rid").hint("merge"), F.col("rid") == F.col("of_rid"))
    pieces = _matching(F.col("text"), lambda p: F.split("text", p, -1))
    filled = let(pieces, lambda pieces: let(F.col("put"), lambda put: F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(put, i)["put"], F.lit(""))))))
    whole = F.array_join(filled, "")
    kinds = F.transform(F.filter("mentions", lambda m: m["of"].isNotNull()), lambda m: m["of"])
    return plain.unionAll(joined.select("row", whole.alias("text"), kinds.alias("kinds")))


def write_replaced(docs: DataFrame, path: str, text: str = "text", key: str | None = None) -> None:
    """Write what `replace` gives to path, and delete the tables that held texts in clear."""
    scratch = Scratch(docs.sparkSession, "pii")
    try:
        replace(docs, text, key, scratch).select("row.*", F.col("text").alias("replaced"), "kinds").write.parquet(path)
    finally:
        scratch.clear()


def op10_pii(spark, sf_dir):
    of = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    found = replace(documents(spark, sf_dir))
    return found.select("row.doc_id", F.size("kinds").cast("long").alias("n_entities"), *map(of, ("email", "name", "phone", "ssn", "ip", "card")), "text")
