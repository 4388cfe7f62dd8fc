"""Text scalars, containment, tiers and addresses over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import text as T
from tallymark.operators import containment as C
from tallymark.operators import urls
from tallymark.operators.sources import check_sources, newest
from tallymark.sources.html import page_kind
from tallymark.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def words_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("w", T.words(F.col("text")))
    return d.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"), F.size(T.distinctive(F.col("w"))).alias("n_distinctive"))


def distinct_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("w", T.words(F.col("text")))
    return d.select("doc_id", F.size(T.ngrams(F.col("w"), 2)).alias("n_bigrams"), F.size(T.ngrams(F.col("w"), 3)).alias("n_trigrams"))


def numbers_in_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.numbers(F.col("text"))).alias("number"))


def quantities_in_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.quantities(F.col("text"))).alias("quantity"))


def identifiers_in_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.letter_identifiers(F.col("text"))).alias("identifier"))


def sentence_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "claims", "claim_key", "claim").select("claim_key", F.size(T.sentences(F.col("claim"))).alias("n_sentences"))


def number_context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.explode(T.number_windows(F.col("claim"))).alias("w")
    return table(spark, sf_dir, "claims", "claim_key", "claim").select("claim_key", w).select("claim_key", F.col("w.number").alias("number"), F.concat_ws(" ", "w.near").alias("near"))


def claim_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("claim")
    return table(spark, sf_dir, "claims", "claim_key", "claim").select("claim_key", T.salience(c).alias("salience"), F.concat_ws(",", T.salience_tags(c)).alias("tags"))


def previous_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each sentence of a draft the nearest one before it with four words or more: what a trailing citation stands for."""
    d = table(spark, sf_dir, "documents", "doc_id", "doc_kind", "text").where("doc_kind = 'draft'")
    s = d.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n+"))).withColumn("n", F.size(F.split(F.trim("col"), r"\s+")))
    w = F.expr("last(case when n >= 4 then pos end, true) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding)")
    return s.select("doc_id", "pos", w.alias("previous"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fetch of every url."""
    f = table(spark, sf_dir, "fetch_results", "fetch_id", "url", "status", "text", "final_url", "content_type", "kind", "error", "blocked", "truncated", "fetched_at", "ingested_at")
    return newest(f, "url", "fetched_at", "ingested_at", "fetch_id")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest archive lookup of every url, with the archived page where the cache holds it."""
    c = table(spark, sf_dir, "page_cache", "cache_id", "kind", "url", "stored_at", "data")
    look = c.where("kind = 'wayback'").select("url", "stored_at", "cache_id", F.col("data.extra")["date"].alias("snapshot_date"), F.col("data.extra")["snapshot_url"].alias("snapshot_url"))
    look = newest(look, "url", "stored_at", "cache_id").select("url", "snapshot_date", "snapshot_url")
    page = c.where("kind = 'page'").select("url", "stored_at", "cache_id", F.col("data.status").alias("a_status"), F.col("data.text").alias("a_text"), F.col("data.kind").alias("a_kind"), F.col("data.truncated").alias("a_truncated"))
    page = newest(page, "url", "stored_at", "cache_id").drop("stored_at", "cache_id")
    return look.join(page, "url", "left")


def claim_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim's tier against the newest fetch of its source, or the archive."""
    c = table(spark, sf_dir, "claims", "claim_key", "claim", "source_url", "expect", "on_page")
    return check_sources(c, pages(spark, sf_dir), snapshots(spark, sf_dir)).drop("claim", "source_url")


def source_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which branch of the decision tree each claim's source takes, and against what it is checked."""
    return claim_tiers(spark, sf_dir).select("claim_key", "branch", "checked_against", "http_status", "offline_miss")


def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tier_counts(claim_tiers(spark, sf_dir))


def blocking_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.blocking_reason(tier_counts(spark, sf_dir))


def containment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerators and denominators of each claim's containment in its newest page."""
    c = table(spark, sf_dir, "claims", "claim_key", "claim", "source_url").withColumn("cw", T.words(F.col("claim")))
    c = c.select("claim_key", F.col("source_url").alias("url"), T.ngrams(F.col("cw"), 3).alias("c3"), T.ngrams(F.col("cw"), 2).alias("c2"), T.distinctive(F.col("cw")).alias("cd"))
    p = pages(spark, sf_dir).select("url", T.words(F.col("text")).alias("pw"))
    p = p.select("url", T.ngrams(F.col("pw"), 3).alias("p3"), T.ngrams(F.col("pw"), 2).alias("p2"), F.array_distinct("pw").alias("p1"))
    n = lambda a, b: F.size(F.array_intersect(a, b))
    return c.join(p, "url").select("claim_key", F.size("c3").alias("of3"), n("c3", "p3").alias("in3"), F.size("c2").alias("of2"), n("c2", "p2").alias("in2"), F.size("cd").alias("of_topical"), n("cd", "p1").alias("in_topical"))


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("source_url")
    return table(spark, sf_dir, "claims", "claim_key", "source_url").select("claim_key", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.is_web(u).alias("is_web"), urls.bot_walled(u).alias("walled"), urls.canonical(u).alias("fetch_url"))


def url_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "claims", "source_url").distinct().select("source_url", urls.url_problem("source_url").alias("problem"))


def link_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = urls.link_status(F.col("url"), F.col("status"), F.col("final_url"), F.col("blocked"))
    return pages(spark, sf_dir).groupBy(s.alias("link_status")).agg(F.count("*").alias("n"))


def thin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("url", (T.stripped_length(F.col("text")) < C.MIN_PAGE_CHARS).alias("thin"))


def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind that each fetch's type and first bytes speak for."""
    f = table(spark, sf_dir, "fetch_results", "fetch_id", "content_type", "text").distinct()
    return f.select("fetch_id", page_kind(F.col("content_type"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("kind"))


def squashed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "claims", "claim_key", "claim").select("claim_key", T.squash(F.col("claim")).alias("claim"))


def snapshot_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived captures and the addresses under which their raw pages are read."""
    url = F.col("data.extra")["snapshot_url"]
    return table(spark, sf_dir, "page_cache", "cache_id", "kind", "data").where("kind = 'wayback'").where(url.isNotNull()).select("cache_id", urls.raw_snapshot(url).alias("raw_url")).distinct()


def missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of each claim that its newest page lacks."""
    c = table(spark, sf_dir, "claims", "claim_key", "claim", "source_url").select("claim_key", F.col("source_url").alias("url"), T.numbers(F.col("claim")).alias("c"))
    p = pages(spark, sf_dir).select("url", T.numbers(F.col("text")).alias("p"))
    return c.join(p, "url").select("claim_key", F.explode(F.array_except("c", "p")).alias("number"))


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags against the gold labels: a claim is flagged if its tier blocks."""
    t = claim_tiers(spark, sf_dir).where("on_page is not null").select("on_page", C.is_blocking(F.col("tier")).alias("flagged"))
    n = lambda c: F.count_if(c)
    g, f = F.col("on_page"), F.col("flagged")
    t = t.agg(n(~g & f).alias("tp"), n(g & f).alias("fp"), n(~g & ~f).alias("fn"), n(g & ~f).alias("tn"))
    return t.withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn"))).withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp")))


def all_pairs_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation items against all documents by an inverted index of trigrams: pairs that share any."""
    d = _docs(spark, sf_dir).withColumn("w", T.words(F.col("text"))).select("doc_id", F.explode(T.ngrams(F.col("w"), 3)).alias("gram"))
    i = table(spark, sf_dir, "eval_items", "item_id", "text").withColumn("w", T.words(F.col("text"))).select("item_id", T.ngrams(F.col("w"), 3).alias("grams"))
    i = i.select("item_id", F.size("grams").alias("of3"), F.explode("grams").alias("gram"))
    return d.join(i, "gram").groupBy("doc_id", "item_id", "of3").agg(F.count("*").alias("in3"))


_W = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9'']+')"
_GRAM = "list_distinct([{parts} for i in range(1, len(w) - {n} + 2)])"
_BI = "case when len(w) >= 2 then list_distinct([w[i] || ' ' || w[i+1] for i in range(1, len(w))]) else [] end"
_TRI = "case when len(w) >= 3 then list_distinct([w[i] || ' ' || w[i+1] || ' ' || w[i+2] for i in range(1, len(w) - 1)]) else [] end"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_DIST = f"list_distinct([x for x in w if length(x) > 3 and not list_contains({_STOP}, x)])"
_NORM = "regexp_replace(replace({0}, ',', ''), '\\.0+$', '')"
_PAGES = """select * from fetch_results where url is not null qualify row_number() over (partition by url
  order by fetched_at desc nulls last, ingested_at desc nulls last, fetch_id desc nulls last) = 1"""
_SCHEME = "lower(regexp_extract(coalesce({0}, ''), '^\\s*([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"
_HOST = "lower(regexp_replace(regexp_extract(coalesce({0}, ''), '^\\s*[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]*)', 1), '\\.+$|[\\[\\]]', '', 'g'))"
_STRIPPED = "length(regexp_replace(coalesce({0}, ''), '^[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+|[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+$', '', 'g'))"
_PLAIN = "regexp_replace(regexp_replace({0}, '#.*$', ''), '/+$', '')"

# Marks of a word's inside and outside that hold for all scripts, as DuckDB's own boundary is that of ASCII.
_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ON, _OFF = r"[\p{L}\p{N}\p{M}\p{Pc}]", r"[^\p{L}\p{N}\p{M}\p{Pc}]"
_DIGITS = r"\p{Nd}+(?:[.,]\p{Nd}+)*"
_SCALE = "case lower({0}) " + " ".join(f"when '{k}' then '{v}'" for k, v in T.SCALES.items()) + " end"
# A letter that its word goes on behind, in other letters than ASCII ones, is marked, so that a unit ends at its word's end.
_MARKED = r"regexp_replace(coalesce({0}, ''), '([A-Za-z])([0-9_]|[^\x00-\x7F\p{{Z}}\p{{P}}\p{{S}}\p{{C}}]|[^\x00-\x7F\P{{Pc}}])', '\1' || chr(1) || '\2', 'g')"
_FLAT = r"regexp_replace(regexp_replace(coalesce({0}, ''), '[^\x00-\x7F\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}]', '.', 'g'), '[^\x00-\x7F]', '_', 'g')"
_ABBREVIATED = r"'(^|" + _OFF + r")(Mr|Ms|Dr|St|Mrs|Prof|[A-Z])\.', '\1\2' || chr(1), 'g'"
_SHIELDED = f"regexp_replace(regexp_replace(coalesce({{0}}, ''), {_ABBREVIATED.replace('{', '{{').replace('}', '}}')}), {_ABBREVIATED.replace('{', '{{').replace('}', '}}')})"
_PARTS = "string_split(regexp_replace(" + _SHIELDED + r""", '([.!?]["'')\]]*)[ \t\n\x0b\f\r]+(["''(\[]*[A-Z])', '\1' || chr(2) || '\2', 'g'), chr(2))"""
_HEDGED = r"may|might|could|would|should|perhaps|possibly|likely|probably|i think|we think|in my (?:view|opinion)|arguably|seems?|appears?"
_TAGS = rf"""[x for x in [
  case when regexp_matches(t, '\p{{Nd}}') then 'number' end,
  case when regexp_matches(t, '["“”''‘’]') then 'quotation' end,
  case when regexp_matches(t, '(?s)(?:(?:^|[^.!?])[ \t\n\x0b\f\r]|[^\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}\s\x0b])[A-Z][a-zA-Z0-9]{{2,}}(?:$|{_OFF})') then 'proper-noun' end,
  case when regexp_matches(t, '(?i)(?:^|{_OFF})(?:{_HEDGED})(?:$|{_OFF})') then 'hedged' end] if x is not null]"""

SQL = {
    "quantities_in_docs": rf"""with q as (select doc_id, unnest(regexp_extract_all({_MARKED.format("text")}, '{_DIGITS}{_WS}*(?:%|[A-Za-z]+\x01?)')) as m from documents),
      u as (select doc_id, {_NORM.format(f"regexp_extract(m, '^{_DIGITS}')")} as number, {_SCALE.format("regexp_extract(m, '(%|[A-Za-z]+)$', 1)")} as scale from q where m not like '%' || chr(1))
      select distinct doc_id, number || ' ' || scale as quantity from u where scale is not null""",
    "identifiers_in_docs": rf"""select distinct doc_id, identifier from (select doc_id, unnest(regexp_extract_all({_FLAT.format("text")}, '\b[A-Z][a-z]+ [A-Z]\b')) as identifier from documents) where identifier not like '% I'""",
    "sentence_breaks": f"select claim_key, len({_PARTS.format('claim')})::int as n_sentences from claims",
    "number_context_windows": rf"""with s as (select claim_key, unnest({_PARTS.format("claim")}) as s from claims), t as (select claim_key, regexp_extract_all(s, '{_DIGITS}|[A-Za-z][A-Za-z'']*') as w from s),
      i as (select claim_key, w, unnest(range(1, len(w) + 1)) as i from t)
      select claim_key, {_NORM.format("w[i]")} as number, array_to_string([x for x in list_concat(w[greatest(i - 4, 1) : i - 1], w[i + 1 : i + 4]) if regexp_matches(x, '^[A-Za-z]')], ' ') as near from i where regexp_matches(w[i], '^\p{{Nd}}')""",
    "claim_salience": f"""with c as (select claim_key, {_TAGS} as tags from (select claim_key, coalesce(claim, '') as t from claims))
      select claim_key, coalesce(list_sum([case x when 'number' then 3 when 'quotation' then 2 when 'proper-noun' then 1 else -2 end for x in tags]), 0)::int as salience, array_to_string(tags, ',') as tags from c""",
    "words_per_doc": f"with d as (select doc_id, {_W.format('text')} as w from documents) select doc_id, len(w)::int as n_words, len(list_distinct(w))::int as n_distinct, len({_DIST})::int as n_distinctive from d",
    "distinct_ngrams": f"with d as (select doc_id, {_W.format('text')} as w from documents) select doc_id, len({_BI})::int as n_bigrams, len({_TRI})::int as n_trigrams from d",
    "numbers_in_docs": f"select distinct doc_id, {_NORM.format('n')} as number from (select doc_id, unnest(regexp_extract_all(text, '[\\p{{Nd}}]+(?:[.,][\\p{{Nd}}]+)*')) as n from documents)",
    "previous_sentences": """with s as (select doc_id, unnest(range(len(l)))::int as pos, unnest(l) as line from (select doc_id, regexp_split_to_array(coalesce(text, ''), '\\n+') as l from documents where doc_kind = 'draft'))
      select doc_id, pos, last_value(case when len(regexp_split_to_array(trim(line), '\\s+')) >= 4 then pos end ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as previous from s""",
    "containment_scores": f"""with p as ({_PAGES}), pg as (select url, w, {_TRI} as p3, {_BI} as p2 from (select url, {_W.format('text')} as w from p)),
      c as (select claim_key, url, {_TRI} as c3, {_BI} as c2, {_DIST} as cd from (select claim_key, source_url as url, {_W.format('claim')} as w from claims))
      select claim_key, len(c3)::int as of3, len(list_intersect(c3, p3))::int as in3, len(c2)::int as of2, len(list_intersect(c2, p2))::int as in2,
             len(cd)::int as of_topical, len(list_intersect(cd, w))::int as in_topical from c join pg using (url)""",
    "url_hosts": f"""with u as (select claim_key, source_url, {_SCHEME.format('source_url')} as scheme, {_HOST.format('source_url')} as host from claims)
      select claim_key, scheme, host, scheme in ('http', 'https') and host <> '' as is_web,
             list_extract([d for d in {list(urls.BOT_WALLED)} if host = d or ends_with(host, '.' || d)], 1) as walled,
             case when host in ('reddit.com', 'www.reddit.com') then regexp_replace(source_url, '^(\\s*[A-Za-z]+://)(?:[^/?#@]*@)?[^/?#:]+', '\\1old.reddit.com') else source_url end as fetch_url from u""",
    "source_branches": f"""with p as ({_PAGES}), look as (select url, data.extra['snapshot_url'] as snapshot from page_cache where kind = 'wayback' and url is not null qualify row_number() over (partition by url order by stored_at desc nulls last, cache_id desc nulls last) = 1),
      arch as (select look.url, g.status as a_status, g.text as a_text, g.kind as a_kind from look join (select url, data.status as status, data.text as text, data.kind as kind from page_cache where kind = 'page' and url is not null
        qualify row_number() over (partition by url order by stored_at desc nulls last, cache_id desc nulls last) = 1) g using (url)),
      u as (select claim_key, source_url, {_SCHEME.format('source_url')} as scheme, {_HOST.format('source_url')} as host from claims),
      c as (select claim_key, source_url, scheme in ('http', 'https') and host <> '' as web, list_extract([d for d in {list(urls.BOT_WALLED)} if host = d or ends_with(host, '.' || d)], 1) is not null as walled,
        case when host in ('reddit.com', 'www.reddit.com') then regexp_replace(source_url, '^(\\s*[A-Za-z]+://)(?:[^/?#@]*@)?[^/?#:]+', '\\1old.reddit.com') else source_url end as fetch_url from u),
      j as (select c.*, p.url is not null as there, p.blocked, p.status, p.kind, p.text, a_status < 400 as archived, coalesce(a_text, '') <> '' as a_has, a_kind, p.status is null or p.status >= 400 as failed from c left join p on c.web and p.url = c.fetch_url left join arch on arch.url = c.source_url),
      k as (select *, not failed and coalesce(kind in ('pdf', 'binary'), false) as unreadable, {_STRIPPED.format('text')} < 200 as short from j),
      b as (select *, case when not web then 'invalid' when coalesce(blocked, false) then 'blocked' when not there then 'offline'
        when (failed or not unreadable and short) and archived and a_has then 'archive' when failed and archived and a_kind in ('pdf', 'binary') then 'dead_archive' when status = 429 then 'rate_limited'
        when walled and (status in (403, 429) or status = 200 and length(trim(lower(coalesce(text, '')))) <= 200 and (lower(text) like '%{urls.CHALLENGES[0]}%' or lower(text) like '%{urls.CHALLENGES[1]}%')) then 'walled'
        when failed then 'failed' when unreadable then 'unreadable' else 'live' end as branch from k)
      select claim_key, branch, case branch when 'archive' then 'wayback' when 'live' then 'live' else 'none' end as checked_against, case when web then status end as http_status, web and not there as offline_miss from b""",
    # Hosts that are addresses or local names are judged in Python alone; these tables hold none.
    "url_problems": f"""with u as (select distinct source_url, {_SCHEME.format('source_url')} as scheme, {_HOST.format('source_url')} as host from claims)
      select source_url, case when scheme not in ('http', 'https') then 'URL scheme ' || case when scheme = '' then '(none)' else scheme || ':' end || ' is not allowed; only http and https are fetched'
        when host = '' then 'URL has no host' when host = 'localhost' or {' or '.join(f"ends_with(host, '{e}')" for e in urls.LOCAL_ENDINGS)} then 'host ' || host || ' is a local name' end as problem from u""",
    "page_kinds": """with f as (select distinct fetch_id, content_type, text from fetch_results), m as (select fetch_id, coalesce(text, '') as body, lower(trim(regexp_extract(coalesce(content_type, ''), '^[^;]*'))) as mime from f)
      select fetch_id, case when mime = 'application/pdf' or starts_with(body, '%PDF-') then 'pdf' when mime in ('text/html', 'application/xhtml+xml', 'application/xml', 'text/xml') or ends_with(mime, '+xml') then 'html'
        when starts_with(mime, 'text/') or mime in ('application/json', 'application/ld+json') or ends_with(mime, '+json') then 'text' when mime <> '' then 'binary'
        when regexp_matches(left(body, 1024), '(?is)^\\s*(?:<!doctype html|<html)|<body') then 'html' when contains(left(body, 4096), chr(0)) then 'binary' else 'text' end as kind from m""",
    "squashed_claims": f"select claim_key, trim(regexp_replace(coalesce(claim, ''), '(?:{_WS}|[\\x1c-\\x1f])+', ' ', 'g')) as claim from claims",
    "snapshot_addresses": "select distinct cache_id, regexp_replace(data.extra['snapshot_url'], '^(https?://[^/]+/web/\\d+)(?:[a-z]{2}_)?/', '\\1id_/') as raw_url from page_cache where kind = 'wayback' and data.extra['snapshot_url'] is not null",
    "missing_numbers": f"""with p as ({_PAGES}), n as (select url, [{_NORM.format('x')} for x in regexp_extract_all(coalesce(text, ''), '{_DIGITS}')] as have from p),
      c as (select claim_key, source_url as url, list_distinct([{_NORM.format('x')} for x in regexp_extract_all(coalesce(claim, ''), '{_DIGITS}')]) as want from claims)
      select claim_key, unnest([x for x in want if not list_contains(have, x)]) as number from c join n using (url)""",
    "link_status_counts": f"""with p as ({_PAGES}) select case when coalesce(blocked, false) then 'refused' when status is null then 'dead' when status in (401, 403, 429) then 'walled'
      when status >= 400 then 'dead' when final_url is not null and final_url <> '' and {_PLAIN.format('url')} <> {_PLAIN.format('final_url')} then 'redirected' else 'ok' end as link_status, count(*) as n from p group by 1""",
    "thin_pages": f"with p as ({_PAGES}) select url, {_STRIPPED.format('text')} < 200 as thin from p",
    "all_pairs_containment": f"""with d as (select doc_id, unnest({_TRI}) as gram from (select doc_id, {_W.format('text')} as w from documents)),
      i as (select item_id, len(g)::int as of3, unnest(g) as gram from (select item_id, {_TRI} as g from (select item_id, {_W.format('text')} as w from eval_items)))
      select doc_id, item_id, of3, count(*) as in3 from d join i using (gram) group by all""",
}
QUERIES = {
    f.__name__: f
    for f in (words_per_doc, distinct_ngrams, numbers_in_docs, quantities_in_docs, identifiers_in_docs, sentence_breaks, number_context_windows, claim_salience, previous_sentences, containment_scores, claim_tiers, source_branches, page_kinds, squashed_claims, snapshot_addresses, missing_numbers, tier_counts, blocking_reason, confusion_metrics, url_hosts, url_problems, link_status_counts, thin_pages, all_pairs_containment)
}
