"""Tokenisers and text scalars of the scoring side, as column expressions.

All are built-in expressions, so they stay in the JVM. Word classes are ASCII, as the scores are; ``\\d`` and ``\\s`` take
in the digits and spaces of all scripts. A null text is an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say little, words that may open a sentence, scale words and what they stand for.
STOPWORDS = (
    "the and for that this with have has had been was were are its our their they them from into about would could "
    "should just very really some what when where which while than then there here will your you but not all can out"
).split()
SENTENCE_OPENERS = (
    "moreover however furthermore additionally also meanwhile still yet then next finally first second third instead overall "
    "today recently later previously currently thus therefore similarly likewise nevertheless otherwise besides both many most "
    "some several after before since while when although because if in on at by for from with as to of"
).split()
SCALES = {
    "k": "thousand", "thousand": "thousand", "m": "million", "mn": "million", "mm": "million", "million": "million",
    "b": "billion", "bn": "billion", "billion": "billion", "t": "trillion", "tn": "trillion", "trillion": "trillion",
    "%": "percent", "percent": "percent",
}
UNIT_WORDS = [*SCALES, "dollars", "euros", "pounds"]

# Patterns of numbers, quantities and sentence ends, and the reach of a number's context in tokens.
NUMBER = r"\d+(?:[.,]\d+)*"
QUANTITY = rf"(?:{NUMBER})\s*(?:%|[A-Za-z]+)\b(?![\p{{No}}\p{{Nl}}])|(?:{NUMBER})\s*%"
SENTENCE_BREAK = r"""(?<=[.!?])(?<!\bMr\.)(?<!\bMs\.)(?<!\bDr\.)(?<!\bSt\.)(?<!\bMrs\.)(?<!\bProf\.)(?<!\b[A-Z]\.)["')\]]*\s+(?=["'(\[]*[A-Z])"""
NUMBER_REACH = 4


def _t(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def find_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(_t(c), F.lit(pattern), F.lit(0))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def squash(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(_t(c), r"(?U)[\s\x1c-\x1f]+", " "))


def stripped_length(c: Column) -> Column:
    return F.length(F.regexp_replace(_t(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def words(c: Column) -> Column:
    return find_all(F.lower(_t(c)), "[a-z0-9']+")


def ngrams(w: Column, n: int) -> Column:
    """Distinct runs of n words of a word array; none if it is shorter."""
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))
    return F.when(F.size(w) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def hashed_ngrams(w: Column, n: int) -> Column:
    """``ngrams`` as 64-bit hashes: a run of n words is the hash of the words in their order."""
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    return F.when(F.size(w) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def normal_number(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, ",", ""), r"\.0+$", "")


def numbers(c: Column) -> Column:
    return F.array_distinct(F.transform(find_all(c, rf"(?U){NUMBER}"), normal_number))


def quantities(c: Column) -> Column:
    """Numbers with their scale, as ``40 million``."""
    scale = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])

    def read(m: Column) -> Column:
        unit = F.lower(F.regexp_extract(m, r"(%|[A-Za-z]+)$", 1))
        return F.concat_ws(" ", normal_number(F.regexp_extract(m, rf"(?U)^{NUMBER}", 0)), scale[unit])

    found = F.transform(find_all(c, rf"(?U){QUANTITY}"), read)
    return F.array_distinct(F.filter(found, lambda q: q.contains(" ")))


def letter_identifiers(c: Column) -> Column:
    """A capitalised word and one capital letter, as ``Series B``; not the pronoun."""
    return F.array_distinct(F.filter(find_all(c, r"\b[A-Z][a-z]+ [A-Z]\b"), lambda x: ~x.endswith(" I")))


def sentences(c: Column) -> Column:
    return F.split(_t(c), SENTENCE_BREAK)


def names(c: Column) -> Column:
    """Capitalised words in order, without the first of the text and ordinary openers of later sentences."""
    plain = _strings(sorted({*STOPWORDS, *SENTENCE_OPENERS}))

    def of(tokens: Column, i: Column) -> Column:
        skip = (i == 0) | F.coalesce(F.array_contains(plain, F.lower(F.get(tokens, F.lit(0)))), F.lit(False))
        return F.filter(tokens, lambda t, k: ((k > 0) | ~skip) & (F.length(t) >= 2) & t.rlike("^[A-Z]"))

    return F.array_distinct(F.flatten(F.transform(_tokens(c, "[A-Za-z][A-Za-z']*"), of)))


def _tokens(c: Column, pattern: str) -> Column:
    """Each sentence's tokens. Lambdas over this array get the tokens as a value; a token pattern inside them would be matched again for every element."""
    return F.transform(sentences(c), lambda s: find_all(s, pattern))


def number_windows(c: Column) -> Column:
    """array<struct<number, near>>: each number with the words at most four tokens away in its sentence."""

    def of(tokens: Column) -> Column:
        def window(t: Column, i: Column) -> Column:
            before = F.slice(tokens, F.greatest(i + 1 - NUMBER_REACH, F.lit(1)), F.least(i, F.lit(NUMBER_REACH)))
            near = F.filter(F.concat(before, F.slice(tokens, i + 2, NUMBER_REACH)), lambda w: w.rlike("^[A-Za-z]"))
            return F.when(t.rlike(r"(?U)^\d"), F.struct(normal_number(t).alias("number"), near.alias("near")))

        return F.array_compact(F.transform(tokens, window))

    return F.flatten(F.transform(_tokens(c, rf"(?U){NUMBER}|[A-Za-z][A-Za-z']*"), of))


def context_words(w: Column) -> Column:
    dull = _strings(sorted({*STOPWORDS, *UNIT_WORDS}))
    return F.array_distinct(F.filter(F.transform(w, F.lower), lambda x: (F.length(x) > 3) & ~F.array_contains(dull, x)))


def distinctive(w: Column) -> Column:
    dull = _strings(STOPWORDS)
    return F.array_distinct(F.filter(w, lambda x: (F.length(x) > 3) & ~F.array_contains(dull, x)))


# Patterns of hedging words and of names.
HEDGES = r"(?i)\b(?:may|might|could|would|should|perhaps|possibly|likely|probably|i think|we think|in my (?:view|opinion)|arguably|seems?|appears?)\b"
PROPER_NOUN = r"(?<![.!?]\s)(?<!^)\b[A-Z][a-zA-Z0-9]{2,}\b"


def salience_tags(c: Column) -> Column:
    """What makes a claim falsifiable, and what weakens it."""
    signs = {"number": r"(?U)\d", "quotation": "[\"“”'‘’]", "proper-noun": PROPER_NOUN, "hedged": HEDGES}
    return F.array_compact(F.array(*[F.when(_t(c).rlike(p), F.lit(t)) for t, p in signs.items()]))


def salience(c: Column) -> Column:
    """3 for a number, 2 for a quotation, 1 for a name, less 2 for a hedge; orders, never filters."""
    weights = F.create_map(*[F.lit(x) for kv in (("number", 3), ("quotation", 2), ("proper-noun", 1), ("hedged", -2)) for x in kv])
    return F.aggregate(salience_tags(c), F.lit(0), lambda a, t: a + weights[t])
