"""Reports of a run: JSON, text table, annotated claims, exit code and an HTML certificate."""

from __future__ import annotations

import html
import json
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallymark.operators.containment import DISQUALIFYING, LABELS, NEEDS_REVIEW, TIERS, is_blocking

SCHEMA_VERSION = 1
#: Exit codes: shippable, blocked, wrong usage or input, offline miss, internal error, interrupted. A block goes before an error, an error before a miss.
OK, BLOCKED, USAGE, OFFLINE, INTERNAL, INTERRUPTED = 0, 1, 2, 3, 4, 130


def now() -> str:
    return datetime.now(UTC).replace(microsecond=0).isoformat().replace("+00:00", "Z")


def summary(results: DataFrame, strict: bool = False) -> dict:
    """Totals of a run in one aggregate."""
    n = [F.count_if(F.col("tier") == t).alias(t) for t in TIERS]
    r = results.agg(F.count("*").alias("total"), *n, F.count_if(is_blocking(F.col("tier"), strict)).alias("blocking"), F.count_if("offline_miss").alias("offline_misses")).first().asDict()
    counts = {t: r[t] for t in TIERS}
    return {"total": r["total"], "counts": counts, "blocking": r["blocking"], "offline_misses": r["offline_misses"], "exit_code": exit_code(r["blocking"], r["offline_misses"])}


def plural(n: int, one: str, many: str = "") -> str:
    """A count with its noun."""
    return f"{n} {one if n == 1 else many or one + 's'}"


def agree(n: int, one: str, many: str) -> str:
    """The form that agrees with a count."""
    return one if n == 1 else many


def sentences(counts: dict[str, int], offline_misses: int = 0, strict: bool = False) -> list[str]:
    """What a run's counts say, in words; nothing is said of what didn't happen."""
    total, unchecked = sum(counts.values()), counts.get("unverified", 0) + counts.get("snippet_only", 0)
    listed = ", ".join(f"{counts[t]} {LABELS[t].lower()}" for t in TIERS if counts.get(t)) or "none"
    n = counts.get
    told = [
        (True, f"{plural(total, 'claim')} checked: {listed}."),
        (n("unsupported"), f"{plural(n('unsupported', 0), 'claim')} {agree(n('unsupported', 0), 'is', 'are')} not on the page pointed to, which loaded and was readable."),
        (n("broken"), f"{plural(n('broken', 0), 'source')} {agree(n('broken', 0), 'is', 'are')} unreachable or invalid."),
        (n("low_match"), f"{plural(n('low_match', 0), 'claim')} {agree(n('low_match', 0), 'shares', 'share')} words with {agree(n('low_match', 0), 'its', 'their')} page but {agree(n('low_match', 0), 'is', 'are')} not quoted from it; a person must look."),
        (strict and unchecked, f"{plural(unchecked, 'claim')} {agree(unchecked, 'was', 'were')} never checked against a page's text."),
        (offline_misses, f"{plural(offline_misses, 'source')} had no stored copy."),
    ]
    return [text for holds, text in told if holds]


def exit_code(blocking: int, offline_misses: int, internal_errors: int = 0) -> int:
    return BLOCKED if blocking else INTERNAL if internal_errors else OFFLINE if offline_misses else OK


def write_report(results: DataFrame, path: str) -> None:
    """One JSON line per result in input order; scores to four places, rounded by their exact binary value."""
    rounded = results.withColumns({c: exactly_rounded(F.col(c)) for c in ("quoted", "topical")})
    rounded.orderBy("index").write.mode("overwrite").json(path)


@F.pandas_udf(DoubleType())
def exactly_rounded(c: pd.Series) -> pd.Series:
    """Scores to four places by the exact value of each double; the JVM rounds its shortest decimal form, which breaks ties otherwise."""
    return c.map(lambda v: round(v, 4), na_action="ignore")


def header(results: DataFrame, *, strict: bool = False, offline: bool = False, wayback: bool = True, checked_at: str | None = None) -> str:
    """The versioned object that stands before a report's results, as JSON."""
    return json.dumps({"schema_version": SCHEMA_VERSION, "checked_at": checked_at or now(), "options": {"strict": strict, "offline": offline, "wayback": wayback}, "summary": summary(results, strict)})


def annotated(results: DataFrame, verified_at: str | None = None) -> DataFrame:
    """(index, json): every entry with all its keys and its tier, note and date beside them."""
    extra = F.to_json(F.struct(F.col("tier").alias("verification_tier"), F.col("note").alias("verification_note"), F.lit(verified_at or now()[:10]).alias("verified_at")))
    body = F.to_json("entry")
    return results.select("index", F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.when(F.length(body) > 2, ",").otherwise(""), F.substring(extra, 2, 1 << 30)).alias("json"))


def text_table(results: DataFrame) -> DataFrame:
    """(index, line): id, label and scores of each result, as a terminal shows them."""
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.col("tier")]
    return results.select("index", F.format_string("%-26s  %-13s  quoted %.2f  topical %.2f", F.substring("id", 1, 26), label, "quoted", "topical").alias("line"))


def certificate(results: DataFrame, title: str, excluded: DataFrame | None = None) -> str:
    """An HTML page of one document's results by tier, most severe first, with a tally and what was not checked; all is escaped, only web links link.

    For a document's worth of results: they are collected.
    """
    rows = results.orderBy("line").collect()
    worst = {r.tier for r in rows}
    verdict = "Not safe to ship" if worst & set(DISQUALIFYING) else "Needs review" if worst & set(NEEDS_REVIEW) else "No blocking claims"
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><p class=verdict>{verdict}</p>"]
    tally = {t: sum(r.tier == t for r in rows) for t in TIERS}
    out.append("<p class=tally>" + html.escape(", ".join(f"{LABELS[t]}: {n}" for t, n in tally.items() if n) or "No claims") + "</p>")
    for tier in TIERS:
        group = [r for r in rows if r.tier == tier]
        if group:
            out.append(f"<h2>{html.escape(LABELS[tier])} ({len(group)})</h2><ul>")
            for r in group:
                url = html.escape(r.source_url or "", quote=True)
                link = f'<a href="{url}" rel="nofollow noopener">{url}</a>' if (r.source_url or "").lower().startswith(("http://", "https://")) else url
                out.append(f"<li>line {r.line}: {html.escape(r.claim or '')}<br>{link}<br>{html.escape(r.note or '')}</li>")
            out.append("</ul>")
    skipped = excluded.select("line", "source_url", "reason").orderBy("line", "source_url").collect() if excluded is not None else []
    if skipped:
        out.append(f"<h2>Not checked ({len(skipped)})</h2><table>")
        out += [f"<tr><td>line {x.line}<td>{html.escape(x.source_url or '')}<td>{html.escape(x.reason or '')}</tr>" for x in skipped]
        out.append("</table>")
    return "\n".join(out)
