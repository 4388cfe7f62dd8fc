"""Is a claim contained in a page? Features of each side once, set algebra on the joined pair, then the tier.

Page features are made once per page, not per claim; the word array is referenced by several features, so
the optimiser keeps it as a column of its own. Words and runs of words are 64-bit hashes on both sides, so what goes through an
exchange with an address is a few bytes for each, not the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import text as T

# Thresholds and tiers in order of severity.
QUOTED, SUPPORTED, MIN_PAGE_CHARS, BIGRAM_WEIGHT = 0.55, 0.10, 200, 0.8
TIERS = ("unsupported", "broken", "low_match", "unverified", "snippet_only", "verified")
DISQUALIFYING, NEEDS_REVIEW, UNCHECKED = ("unsupported", "broken"), ("low_match",), ("unverified", "snippet_only")
LABELS = {"verified": "Verified", "snippet_only": "Snippet-only", "low_match": "Needs review", "unsupported": "Not on page", "unverified": "Unverified", "broken": "Broken source"}
NOTE_THIN = "Source page yielded too little extractable text to check against"
NOTE_SPECIFICS = "Claim's specifics are not on the page it cites: "
NOTE_STRAY = "Claim's numbers are on the page but not next to the claim's words: "
NOTE_REVIEW = "; needs human review"
NOTE_TOPICAL = "Claim shares vocabulary with the page but is not quoted from it; needs human review"
NOTE_ABSENT = "Claim is not found on the page it cites"


def claim_features(df: DataFrame, claim: str = "claim") -> DataFrame:
    """Adds the columns c_words, c_tri, c_bi, c_distinctive, c_numbers, c_quantities, c_identifiers, c_names, c_windows."""
    c = F.col(claim)
    return (
        df.withColumn("c_words", T.words(c))
        .withColumn("c_tri", T.hashed_ngrams(F.col("c_words"), 3))
        .withColumn("c_bi", T.hashed_ngrams(F.col("c_words"), 2))
        .withColumn("c_distinctive", F.transform(T.distinctive(F.col("c_words")), lambda w: F.xxhash64(w)))
        .withColumn("c_numbers", T.numbers(c))
        .withColumn("c_quantities", T.quantities(c))
        .withColumn("c_identifiers", T.letter_identifiers(c))
        .withColumn("c_names", T.names(c))
        .withColumn("c_windows", T.number_windows(c))
    )


def page_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by p_chars, p_words, p_bi, p_tri (distinct hashes), p_numbers, p_quantities, p_windows."""
    t = F.col(text)
    return (
        df.withColumn("_w", T.words(t))
        .withColumn("p_chars", T.stripped_length(t))
        .withColumn("p_tri", T.hashed_ngrams(F.col("_w"), 3))
        .withColumn("p_bi", T.hashed_ngrams(F.col("_w"), 2))
        .withColumn("p_words", T.hashed_ngrams(F.col("_w"), 1))
        .withColumn("p_numbers", T.numbers(t))
        .withColumn("p_quantities", T.quantities(t))
        .withColumn("p_windows", T.number_windows(t))
        .drop("_w", text)
    )


def _share(a: str, b: str) -> Column:
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def signals(df: DataFrame) -> DataFrame:
    """Adds quoted and topical, both over the claim alone."""
    none = (F.size("c_words") == 0) | (F.size("p_words") == 0)
    quoted = F.greatest(_share("c_tri", "p_tri"), F.lit(BIGRAM_WEIGHT) * _share("c_bi", "p_bi"))
    return df.withColumn("quoted", F.when(none, 0.0).otherwise(quoted)).withColumn("topical", F.when(none, 0.0).otherwise(_share("c_distinctive", "p_words")))


def missing_specifics() -> Column:
    """Numbers, quantities, identifiers and names of the claim that the page lacks, in this order."""
    absent = lambda a, b: F.array_sort(F.array_except(a, b))
    # An identifier is two words: a run of two of the page.
    pair = lambda x: F.xxhash64(*[F.element_at(F.split(F.lower(x), " "), k) for k in (1, 2)])
    identifiers = F.array_sort(F.filter("c_identifiers", lambda x: ~F.array_contains("p_bi", pair(x))))
    before = F.concat(absent("c_numbers", "p_numbers"), absent("c_quantities", "p_quantities"), identifiers)
    lost = F.filter("c_names", lambda n: ~F.array_contains("p_words", F.xxhash64(F.lower(n))))
    return F.concat(before, F.array_except(lost, before))


def stray_numbers() -> Column:
    """Numbers of the claim that the page never puts beside any of the claim's words."""

    def stray(w: Column) -> Column:
        small = T.context_words(F.filter(w["near"], lambda x: x.rlike("^[a-z]")))
        wanted = F.when(F.size(small) > 0, small).otherwise(T.context_words(w["near"]))
        there = F.transform(F.flatten(F.transform(F.filter("p_windows", lambda p: p["number"] == w["number"]), lambda p: p["near"])), F.lower)
        return (F.size(wanted) > 0) & ~F.arrays_overlap(wanted, there)

    return F.array_distinct(F.transform(F.filter("c_windows", stray), lambda w: w["number"]))


def with_tier(df: DataFrame) -> DataFrame:
    """Adds quoted, topical, tier and note to joined claim and page features; a page below 200 characters is unverified.

    Stray numbers are looked for only where nothing is missing and the claim is quoted.
    """
    thin = F.col("p_chars") < MIN_PAGE_CHARS
    df = signals(df).withColumn("missing", missing_specifics())
    plain = (F.size("missing") == 0) & (F.col("quoted") >= QUOTED) & ~thin
    df = df.withColumn("stray", F.when(plain, stray_numbers()).otherwise(F.array().cast("array<string>")))
    tier = (
        F.when(thin, "unverified")
        .when(F.size("missing") > 0, "unsupported")
        .when(F.size("stray") > 0, "low_match")
        .when(F.col("quoted") >= QUOTED, "verified")
        .when(F.col("topical") >= SUPPORTED, "low_match")
        .otherwise("unsupported")
    )
    note = (
        F.when(thin, NOTE_THIN)
        .when(F.size("missing") > 0, F.concat(F.lit(NOTE_SPECIFICS), F.concat_ws(", ", "missing")))
        .when(F.size("stray") > 0, F.concat(F.lit(NOTE_STRAY), F.concat_ws(", ", "stray"), F.lit(NOTE_REVIEW)))
        .when(F.col("quoted") >= QUOTED, "")
        .when(F.col("topical") >= SUPPORTED, NOTE_TOPICAL)
        .otherwise(NOTE_ABSENT)
    )
    df = df.withColumn("tier", tier).withColumn("note", note)
    return df.withColumns({c: F.when(thin, 0.0).otherwise(F.col(c)) for c in ("quoted", "topical")})


def is_blocking(tier: Column, strict: bool = False) -> Column:
    return tier.isin(*DISQUALIFYING, *NEEDS_REVIEW, *(UNCHECKED if strict else ()))


def severity(tier: Column) -> Column:
    """0 for the most severe tier."""
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier) - 1


def tier_counts(df: DataFrame) -> DataFrame:
    """(tier, n) with every tier, those that don't occur as 0."""
    every = df.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    return every.join(df.groupBy("tier").agg(F.count("*").alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def blocking_reason(counts: DataFrame, strict: bool = False) -> DataFrame:
    """One row: why a run with these counts must not ship; null if it may."""
    any_of = lambda tiers: F.coalesce(F.bool_or(F.col("tier").isin(*tiers) & (F.col("n") > 0)), F.lit(False))
    reason = F.when(any_of(DISQUALIFYING), "disqualifying").when(any_of(NEEDS_REVIEW), "needs_review")
    if strict:
        reason = reason.when(any_of(UNCHECKED), "unchecked")
    return counts.agg(reason.alias("reason"))
