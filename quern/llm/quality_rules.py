"""Quality rules: a table of thresholds compiled into one projection.

Every ratio is a built-in column expression over the text, so a scan is followed by one
projection with no shuffle and no Python. Null and empty texts have no words and fail
`min_words`; a repeated row is judged each time it occurs; an empty table gives an empty one;
other columns of the input pass through `keep_good` untouched whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACES, documents, let, words

#: Symbols counted by n_symbols.
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "the be to of and that have with this from are was for it is in on as at by or an "
    "de la que el en los del las por para con una un se es su y "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine auch "
    "le les et des une dans est pour sur au avec du pas"
).split()


@dataclass(frozen=True)
class Rule:
    """Holds if low <= num / den <= high; a zero den counts as one."""

    name: str
    num: str
    den: str
    low: float = 0.0
    high: float = float("inf")


#: The verdict of the method. Each line is one comparison of the compiled projection.
RULES = (
    Rule("min_words", "n_words", "one", low=50),
    Rule("word_length", "word_chars", "n_words", low=2, high=14),
    Rule("symbols", "n_symbols", "n_words", high=0.25),
    Rule("bangs", "n_bangs", "n_words", high=0.25),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.5),
    Rule("stop_words", "n_stop_words", "n_words", low=0.03),
    Rule("letters", "n_letters", "word_chars", low=0.6),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.3),
)


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice, for an array of words.

    Each window's hash is packed above its position into one long, so that one primitive sort
    brings equal hashes together; windows beside an equal hash are then compared as text. The
    position takes as many bits as the document needs, and a shared hash is never trusted.
    """

    def neighbours(s: Column, of) -> Column:
        return F.filter(s, lambda x, k: (of(x) == of(F.get(s, k - 1))) | (of(x) == of(F.get(s, k + 1))))

    def gram(i: Column) -> Column:
        return F.concat_ws(" ", w[i], w[i + 1], w[i + 2])

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1), x + 3) - x))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def exact(at: Column) -> Column:
        grams = F.sort_array(F.transform(at, lambda i: F.struct(gram(i).alias("g"), i.alias("i"))))
        repeated = let(grams, lambda g: neighbours(g, lambda x: x["g"]))
        return let(F.sort_array(F.transform(repeated, lambda x: x["i"])), covered)

    def candidates(bits: Column) -> Column:
        top = lambda x: F.call_function("shiftright", x, bits)
        packed = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.call_function("shiftleft", F.xxhash64(w[i], w[i + 1], w[i + 2]), bits).bitwiseOR(i.cast("long")),
        )
        near = let(F.sort_array(packed), lambda s: neighbours(s, top))
        return F.transform(near, lambda x: (x - F.call_function("shiftleft", top(x), bits)).cast("int"))

    at = let(F.length(F.bin(F.size(w))), candidates)
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(at, exact)).cast("long")


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _stats(text: Column, w: Column) -> Column:
    plain = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    n = {
        "n_words": F.size(w),
        "word_chars": F.length(plain),
        "n_symbols": _without(text, SYMBOLS),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _repeat_words(w),
        "one": F.lit(1),
        "n_lines": F.size(lines),
        "n_bangs": _without(text, "!"),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))),
        "n_letters": F.length(F.regexp_replace(plain, r"\P{L}+", "")),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: F.ltrim(x).rlike(r"^[-*•]"))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))),
    }
    return F.struct(*[c.cast("long").alias(k) for k, c in n.items()])


def quality(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the counts, base_failed, kept, and failed (names of the rules that do not hold)."""

    def verdict(s: Column) -> Column:
        base = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
        broken = []
        for r in rules:
            den = F.greatest(s[r.den], F.lit(1))
            holds = s[r.num] >= F.lit(r.low) * den
            if r.high != float("inf"):
                holds = holds & (s[r.num] <= F.lit(r.high) * den)
            broken.append(F.when(~holds, F.lit(r.name)))
        failed = F.array_compact(F.array(*broken))
        counts = [s[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return let(failed, lambda f: F.struct(*counts, base.alias("base_failed"), (~base & (F.size(f) == 0)).alias("kept"), f.alias("failed")))

    whole = F.coalesce(text, F.lit(""))
    return let(words(text), lambda w: let(_stats(whole, w), verdict))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs whose text passes every rule, with the columns of docs."""
    return docs.filter(quality(F.col(text), rules)["kept"])


def op4_quality_rules(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", quality(F.col("text")).alias("q"))
    return rows.select("doc_id", *[F.col(f"q.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
