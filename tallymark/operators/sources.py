"""The decision tree over a claim's source: live page, archived page, or why neither could be read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import stripped_length
from tallymark.operators import urls
from tallymark.operators.containment import MIN_PAGE_CHARS, claim_features, page_features, with_tier

UNREADABLE = ("pdf", "binary")
#: Bytes that a fetch reads at most.
MAX_BYTES = 5_000_000
#: How the error of a page begins that this program failed on; its claims are unverified and the run goes on.
INTERNAL = "internal_error"
_PAGE = ["status", "content_type", "kind", "error", "blocked", "truncated"]
_FEATURES = ["p_chars", "p_words", "p_bi", "p_tri", "p_numbers", "p_quantities", "p_windows"]


def newest(pages: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the row that comes last by ``order`` (null first); ties go by the row's other values."""
    rest = [c for c in pages.columns if c != key and c not in order and not c.startswith("extra")]
    top = F.max(F.struct(*order, *rest)).alias("_top")
    return pages.where(F.col(key).isNotNull()).groupBy(key).agg(top).select(key, "_top.*")


def check_sources(claims: DataFrame, pages: DataFrame, snapshots: DataFrame, use_archive: bool = True) -> DataFrame:
    """Adds tier, note, quoted, topical, branch, checked_against, http_status and offline_miss to the claims.

    claims: claim, source_url and any other columns. pages: one row per url, as fetched. snapshots: one row per url
    with snapshot_date, snapshot_url and the archived page's a_status, a_text, a_kind, a_truncated. Sources that
    aren't web addresses are not looked up. Features are made once of each page that some claim points to, and of archived pages
    only where the live one failed or is thin; texts stay behind. A null claim is an
    empty one. The join keys are addresses: one that a third of all claims point to is split by adaptive execution.
    """
    c = claim_features(claims).withColumn("_url", F.when(urls.is_web(F.col("source_url")), urls.canonical(F.col("source_url"))))
    asked = c.select("_url", "source_url").where("_url is not null").distinct()
    live = pages.join(asked.select(F.col("_url").alias("url")), "url", "left_semi").withColumn("_t", F.coalesce("text", F.lit("")))
    live = live.withColumn("challenge", urls.is_challenge(F.col("status"), F.col("_t")))
    live = page_features(live, "_t").select(F.col("url").alias("_url"), *[F.col(x).alias(f"l_{x}") for x in (*_PAGE, "challenge")], *_FEATURES, F.lit(True).alias("l_there"))
    # Addresses whose live page says nothing: the archive is asked for these alone.
    length = stripped_length(F.coalesce("text", F.lit("")))
    silent = pages.where("status is null or status >= 400").select("url").unionByName(pages.where("status < 400").where(length < MIN_PAGE_CHARS).select("url"))
    silent = asked.join(silent.select(F.col("url").alias("_url")), "_url", "left_semi").select(F.col("source_url").alias("url"))
    arch = page_features(snapshots.join(silent, "url", "left_semi").withColumn("_t", F.coalesce("a_text", F.lit(""))), "_t")
    arch = arch.select(F.col("url").alias("source_url"), "snapshot_date", "snapshot_url", "a_status", "a_kind", "a_truncated", (F.coalesce("a_text", F.lit("")) != "").alias("a_has"), *[F.col(x).alias("a" + x) for x in arch.columns if x.startswith("p_")])
    j = c.join(live, "_url", "left").join(arch, "source_url", "left")

    status, kind = F.col("l_status"), F.col("l_kind")
    failed = status.isNull() | (status >= 400)
    unreadable = ~failed & kind.isin(*UNREADABLE)
    thin = ~failed & ~unreadable & (F.col("p_chars") < MIN_PAGE_CHARS)
    archived = F.col("a_status").isNotNull() & (F.col("a_status") < 400)
    walled = urls.bot_walled(F.col("source_url"))
    j = (
        j.withColumn("_failed", failed)
        .withColumn("_unreadable", F.coalesce(unreadable, F.lit(False)))
        .withColumn("_archive", F.coalesce((failed | thin) & F.lit(use_archive) & archived & F.col("a_has"), F.lit(False)))
        .withColumn("_dead_archive", F.coalesce(failed & F.lit(use_archive) & archived & F.col("a_kind").isin(*UNREADABLE), F.lit(False)))
    )
    j = j.withColumns({x: F.when(F.col("_archive"), F.col("a" + x)).otherwise(F.col(x)) for x in _FEATURES})
    j = with_tier(j)
    cut = F.coalesce(F.when(F.col("_archive"), F.col("a_truncated")).otherwise(F.col("l_truncated")), F.lit(False)) & (F.col("tier") == "unsupported")
    unproven = F.concat(F.lit(f"Page is larger than the {MAX_BYTES:,}-byte read limit and the claim was not in the part that was read, so its absence is not proven ("), F.col("note"), F.lit(")"))
    j = j.withColumn("note", F.when(cut, unproven).otherwise(F.col("note"))).withColumn("tier", F.when(cut, "unverified").otherwise(F.col("tier")))

    when = F.concat(F.lit("checked against Wayback archive ("), F.coalesce(F.nullif("snapshot_date", F.lit("")), F.lit("undated")), F.lit("), live page "), F.when(F.col("_failed"), "unreachable").otherwise("yielded no text"))
    what = lambda k: F.when(k == "pdf", "a PDF")
    detail = F.when(status.isNotNull(), F.concat(F.lit("HTTP "), status.cast("string"))).otherwise(F.coalesce(F.nullif("l_error", F.lit("")), F.lit("no response")))
    archive = F.lit("no archived copy found" if use_archive else "Wayback fallback disabled")
    # In this order; the first that holds.
    branches = [
        ("invalid", F.col("_url").isNull(), "broken", F.lit("Invalid source_url"), "none"),
        ("internal_error", F.coalesce(F.startswith("l_error", F.lit(INTERNAL)), F.lit(False)), "unverified", F.concat(F.lit("The source could not be processed ("), F.col("l_error"), F.lit("); check this claim by hand.")), "none"),
        ("blocked", F.coalesce("l_blocked", F.lit(False)), "broken", F.concat(F.lit("Source URL "), F.coalesce("l_error", F.lit(""))), "none"),
        ("offline", F.col("l_there").isNull(), "unverified", F.lit("Offline: no cached copy of this source. Run once online with --cache to record it."), "none"),
        ("archive", F.col("_archive"), F.col("tier"), F.concat(F.when(F.col("note") != "", F.concat("note", F.lit("; "))).otherwise(""), when), "wayback"),
        ("dead_archive", F.col("_dead_archive"), "unverified", F.concat(F.lit("Live page unreachable; the Wayback copy ("), F.coalesce(F.nullif("snapshot_date", F.lit("")), F.lit("undated")), F.lit(") is "), F.coalesce(what(F.col("a_kind")), F.lit("non-text content")), F.lit(" and is not read. Check this claim against it by hand.")), "none"),
        ("rate_limited", status == 429, "snippet_only", F.lit("Source rate-limited the fetch (HTTP 429) and no archived copy found; claim is snippet-sourced only"), "none"),
        ("walled", walled.isNotNull() & (status.isin(403, 429) | F.coalesce("l_challenge", F.lit(False))), "snippet_only", F.concat(walled, F.lit(" blocks automated fetch and no archived copy found; claim is snippet-sourced only")), "none"),
        ("failed", F.col("_failed"), "broken", F.concat(F.lit("Source unreachable ("), detail, F.lit(") and "), archive), "none"),
        ("unreadable", F.col("_unreadable"), "unverified", F.concat(F.lit("Source is "), F.coalesce(what(kind), F.concat(F.lit("non-text content ("), F.coalesce(F.nullif("l_content_type", F.lit("")), F.lit("unknown type")), F.lit(")"))), F.lit("; only HTML and plain-text pages are read. Check this claim against the document by hand.")), "none"),
    ]
    # One struct of what the first branch that holds says; a live page that can be read is the last.
    said = F.lit(None)
    for name, condition, t, n, a in reversed([*branches, ("live", F.lit(True), F.col("tier"), F.col("note"), "live")]):
        this = F.struct(F.lit(name).alias("branch"), (F.lit(t) if isinstance(t, str) else t).alias("tier"), n.alias("note"), F.lit(a).alias("checked_against"))
        said = F.when(condition, this).otherwise(said)
    out = j.withColumn("_said", said).select("*", "_said.branch", F.col("_said.tier").alias("_tier"), F.col("_said.note").alias("_note"), "_said.checked_against")
    read = F.col("checked_against") != "none"
    return out.select(
        *claims.columns,
        F.col("_tier").alias("tier"),
        F.col("_note").alias("note"),
        F.when(read, F.col("quoted")).otherwise(0.0).alias("quoted"),
        F.when(read, F.col("topical")).otherwise(0.0).alias("topical"),
        "branch",
        "checked_against",
        F.when(F.col("_url").isNotNull(), status).alias("http_status"),
        (F.col("_url").isNotNull() & F.col("l_there").isNull()).alias("offline_miss"),
    )
