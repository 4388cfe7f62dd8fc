"""The main body of web pages whose text has one block per line; menus, notices and footers are dropped.

Line-block distribution: the lengths of prose lines (markup was stripped by the fetcher) are summed over a sliding window
of lines; a stretch of the body begins where the sum surges and ends where it dives, measured by the page's own
windows, and all stretches that hold a share of the largest one are kept. What the distribution can't tell by
length is told by three kinds of evidence: repetition (a line that stands on every other page of its site is the site's), form
(link bars, breadcrumbs, runs of headlines) and phrases that only notices, offers and footers use. Lines of any length are tested.

Cases: null and empty texts have no lines; an error or notice page keeps its message; a text without
line breaks is one line, which is its body; a page without a web address is judged by itself; rows sent again give their
lines once; a key with several texts gives the lines of all of them.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from functools import cache, lru_cache
from itertools import takewhile

import ahocorasick
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.confusables import skeleton
from tallymark.llm.encoding import garbled, restore, sent
from tallymark.llm.rows import flat_map, host
from tallymark.sources.tables import table

# Phrases of site furniture, by kind, in the languages of the web pages; small letters only.
ADVERT = r"advertisements?|anzeige|werbung|publicité|publicidad|publicidade|реклама|広告|广告|विज्ञापन|โฆษณา|إعلان|sponsored( content)?|story continues below( advertisement)?|continue reading below"
NOTICE = r"\bcookies?\b|クッキー|คุกกี้|कुकी|ملفات تعريف الارتباط|your privacy matters|store information on your device|works best with javascript|javascript for the interactive|datenschutzeinstellungen"
OFFER = r"newsletter|\bin your inbox\b|\bsign up for\b|subscribe (now|today)|abonnez-vous|jetzt abonnieren|suscríbete a|inscreva-se"
SHARE = r"^(share( this)?( story| article)?|artikel teilen|teilen|partager|compartir|compartilhar|поделиться|シェアする|分享|साझा करें|شارك|مشاركة|แชร์)$|^follow us|folgen sie uns|suivez-nous|síguenos|siga-nos|^listen to this article|^photo gallery|^\d+ (comments?|kommentare?|commentaires?|comentarios?|comentários?|комментари\w*|コメント|条评论|टिप्पणियाँ|تعليقات?|ความคิดเห็น)$|^(print|email) this|^コメント|^(комментарии|评论|ความคิดเห็น|تعليقات|टिप्पणियाँ)\b.{0,6}$|^\d+件のコメント|^\d+条评论"
TEASER_HEAD = r"^(most (read|popular)|related( articles| stories)?|more (from|on) .{2,30}|you may also like|mehr zum thema|meistgelesen|lo más leído|noticias relacionadas|à lire aussi|les plus lus|mais lidas|notícias relacionadas|leia mais|читайте также|самое читаемое|関連記事|人気記事|相关阅读|热门文章|और पढ़ें|اقرأ أيضا|الأكثر قراءة|อ่านเพิ่มเติม|ข่าวที่เกี่ยวข้อง|อ่านต่อ)$"
TEASER = r"^(read (also|more)|see also|lesen sie auch|siehe auch|lire aussi|à lire|lea también|le puede interesar|leia também|читайте также|あわせて読みたい|関連記事|相关阅读|延伸阅读|और पढ़ें|यह भी पढ़ें|اقرأ أيضا|อ่านเพิ่มเติม|อ่านต่อ) ?[:：]"
FOOTER = r"(?:^.{0,6}|\s)©|\(c\) \d{4}|all rights reserved|\bis published by .{3,60} (group|ltd|inc)\.?$"
FOOTER_LINE = r"^(back to top|nach oben|haut de page|volver arriba|voltar ao topo|наверх|ページの先頭へ|返回顶部|العودة إلى الأعلى|वापस ऊपर|กลับไปด้านบน)$|^(terms of (use|service)|privacy policy|imprint|impressum|legal notice|aviso legal|mentions légales|termos de uso|пользовательское соглашение|利用規約|使用条款|隐私政策|プライバシーポリシー|उपयोग की शर्तें|شروط الاستخدام|ข้อกำหนดการใช้งาน)$"
CONSENT = r"^(accept|reject) all|^(gérer|configurar|manage|einstellungen)\b.{0,40}(cookies|choices|préférences)"
BYLINE = r"^(by|von|par|por|de la rédaction|автор|текст|بقلم|โดย|लेखक|द्वारा|文)[ :：]\S|^(โดย|记者|記者|文/|作者)|記者[、,]|記者$|^[^,，、.!?]{2,40}[,，] (\d{1,2}\.? )?([^\W\d]+\.? )?\d{4}( г\.?)?$"


_LATIN = re.compile("[A-Za-z]")


def fold(s: str) -> str:
    """Small letters in the form in which look-alikes are equal."""
    if s.isascii():
        return s.lower()
    # A look-alike capital among Latin letters has another small letter than in its own script.
    return skeleton(skeleton(s).lower() if _LATIN.search(s) else s.lower())


#: Words of notices, offers and footers; every phrase that may stand inside a line holds one of them.
KEYS = (
    "cookie クッキー คุกกี้ कुकी ارتباط privacy javascript newsletter inbox subscribe © (c) rights published datenschutz abonnez abonnieren "
    "suscríbete inscreva information sign"
).split()
#: Words by which a notice speaks to its reader about the site.
READER = r"\b(?:we|us|our|you|your|this (?:site|website)|by continuing|accept|reject|settings|partners?|wir|sie|ihre?|unsere?|diese (?:website|seite)|einstellungen|nous|vous|votre|notre|ce site|nos|usamos|utilizamos|nosotros|usted|este sitio|su|seu|nós|nossos?|este site|мы|вы|ваш\w*|наш\w*|этот сайт|сайт)\b|当サイト|このサイト|ご利用|本网站|我们|您|हम|आप|यह साइट|เรา|เว็บไซต์|نحن|موقع|نستخدم"
_START = re.compile(skeleton("|".join((f"(?:{ADVERT})$", SHARE, TEASER, FOOTER_LINE, CONSENT))))
_INSIDE = re.compile(skeleton("|".join((OFFER, FOOTER))))
_NOTICE = re.compile(skeleton(NOTICE))
_READER = re.compile(skeleton(READER))
_HEAD = re.compile(skeleton(TEASER_HEAD))
_BYLINE = re.compile(skeleton(BYLINE))
_TERMINAL = re.compile(r"[.!?…。！？।؟۔:;：]['\"”’»“)\]）」』]*$")
_STOPS = re.compile(r"[.!?。！？।؟۔](?=\s|$)")
_LIST_ITEM = re.compile(r"(?:[•‣▪·*–-]|\d{1,2}[.)])\s+\S")
_LINK_BAR = re.compile(r" +[|·•/»] +")
_BAR_SIGN = re.compile(r" [|·•/»>›] ")
_THAI = re.compile("[\u0e00-\u0e7f]")
_CRUMB = re.compile(r"[^>›»]{1,40}(?: [>›»] [^>›»]+)+$")
#: An item of a link bar or a menu is at most so long; a headline or byline too.
LINK_CHARS, HEADLINE_CHARS = 32, 140
#: Lines in a window; the share of the page's largest window at which a stretch begins, and of its largest stretch that one must hold.
WINDOW, SURGE, STRETCH = 5, 0.04, 0.02
#: A line that stands on such a share of a site's pages, and on so many, is the site's, not the page's.
SITE_SHARE, SITE_PAGES = 0.5, 5

FURNITURE, HEAD, BY, HEADLINE, PROSE, BLANK = "furniture", "head", "byline", "headline", "prose", "blank"


@cache
def _keys() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k in KEYS:
        a.add_word(skeleton(k), 1)
    a.make_automaton()
    return a


def _is_notice(f: str) -> bool:
    """Whether a line is a notice to the reader: every other sentence of it speaks of such things, and it addresses the reader."""
    n = len(_NOTICE.findall(f))
    return n > 0 and 2 * n >= max(1, len(_STOPS.findall(f))) and (not _TERMINAL.search(f) or _READER.search(f) is not None)


def _says_furniture(f: str) -> bool:
    if _START.match(f):
        return True
    if next(_keys().iter(f), None) is None:
        return False
    return _INSIDE.search(f) is not None or _is_notice(f)


def _kind(s: str) -> str:
    """What a line is, by its form and by phrases that only furniture has."""
    if not s:
        return BLANK
    if len(s) > HEADLINE_CHARS:
        return _long_kind(s)
    return _short_kind(s)


def _long_kind(s: str) -> str:
    f = fold(s)
    return FURNITURE if not _LIST_ITEM.match(s) and (_links(s, f) or _says_furniture(f)) else PROSE


@lru_cache(maxsize=50_000)
def _short_kind(s: str) -> str:
    if _LIST_ITEM.match(s):
        return PROSE
    kind = _form(s, fold(s))
    if kind == HEADLINE and not s.isascii() and garbled(s):
        s = re.sub(r"\s+", " ", restore(s)).strip()
        kind = _form(s, fold(s))
    return kind


def _links(s: str, f: str) -> bool:
    """Whether a line is a bar of links or a breadcrumb."""
    if not _BAR_SIGN.search(f):
        return False
    links = _LINK_BAR.split(f)
    if len(links) > 1 and all(len(x) <= LINK_CHARS for x in links) and not (len(links) == 2 and _TERMINAL.search(s)):
        return True
    return _CRUMB.match(f) is not None


def _form(s: str, f: str) -> str:
    if not f.strip():
        return BLANK
    if _HEAD.match(f):
        return HEAD
    if _links(s, f) or _says_furniture(f):
        return FURNITURE
    if _BYLINE.search(f) and not _TERMINAL.search(s.rstrip(".")):
        return BY
    if _TERMINAL.search(s):
        return PROSE
    # Thai ends no sentence with a mark: words of a headline are few, spaces part its sentences.
    if _THAI.search(s) and (len(s) > 45 or " " in s and len(s) > 38):
        return PROSE
    return HEADLINE


def _body(kinds: list[str], lengths: list[int]) -> list[tuple[int, int]]:
    """(first, last) lines of the stretches between surge and dive, judged by the page's own windows; none if there is no prose.

    A stretch begins with the prose line at which the windows' sum rises over a share of the page's largest one, and ends with the
    last prose line before a window without prose.
    """
    n, half = len(kinds), WINDOW // 2
    upto = [0]
    for k, x in zip(kinds, lengths, strict=True):
        upto.append(upto[-1] + (x if k == PROSE else 0))
    block = [upto[min(n, i + half + 1)] - upto[max(0, i - half)] for i in range(n)]
    rise = SURGE * max(block, default=0)
    found: list[list[int]] = []
    for i in range(n):
        if kinds[i] != PROSE:
            continue
        if found and i - found[-1][1] <= WINDOW:
            found[-1][1] = i
        elif block[i] >= rise:
            found.append([i, i])
    most = max((upto[b + 1] - upto[a] for a, b in found), default=0)
    return [(a, b) for a, b in found if upto[b + 1] - upto[a] >= STRETCH * most]


def line_hash(line: str) -> int:
    """Spark's ``xxhash64`` of a string."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def furniture_lines(text: str, site: Collection[int] = ()) -> list[int]:
    """Numbers, from 0, of the lines that aren't the page's article; lines end at ``\\n`` only. site: hashes of the site's own lines."""
    lines = [x.strip() for x in text.split("\n")]
    n = len(lines)
    if n == 1:
        return []
    kinds = [_kind(x) for x in lines]
    if site:
        theirs = [line_hash(x) in site for x in text.split("\n")]
        # A page all of whose lines are the site's is its notice, and keeps it.
        if any(k in (PROSE, HEADLINE, BY) and not t for k, t in zip(kinds, theirs, strict=True)):
            kinds = [FURNITURE if t and k not in (BLANK, HEAD) else k for k, t in zip(kinds, theirs, strict=True)]
    stretches = _body(kinds, [len(x) for x in lines])
    keep = [False] * n
    if not stretches:  # no prose: a bare message or a lone title stays, not a list of pages or a menu
        run = [sum(1 for _ in takewhile(lambda j: kinds[j] == HEADLINE and len(lines[j]) <= LINK_CHARS, r)) for i in range(n) for r in (range(i, n), range(i, -1, -1))]
        listed = False
        for i in range(n):
            listed = kinds[i] == HEAD or listed and kinds[i] == HEADLINE
            keep[i] = kinds[i] in (HEADLINE, BY) and not listed and run[2 * i] + run[2 * i + 1] <= 3
        return [i for i in range(n) if not keep[i] and lines[i]]
    first, last = stretches[0][0], stretches[-1][1]
    for a, b in stretches:
        for i in range(a, b + 1):
            keep[i] = kinds[i] in (PROSE, BY)
    # Above the surge: the byline and the title nearest to it.
    i = first - 1
    while i >= 0 and kinds[i] in (BLANK, FURNITURE):
        i -= 1
    if i >= 0 and kinds[i] == BY:
        keep[i] = True
        i -= 1
        while i >= 0 and kinds[i] in (BLANK, FURNITURE):
            i -= 1
    if i >= 0 and kinds[i] == HEADLINE:
        keep[i] = True
    # Inside: a headline right above a paragraph is a subheading, a run of them or one below a teaser's head is a list of pages.
    i = first
    while i <= last:
        if kinds[i] not in (HEADLINE, HEAD):
            i += 1
            continue
        j = i
        while j <= last and kinds[j] in (HEADLINE, HEAD, BLANK, FURNITURE):
            j += 1
        run = [k for k in range(i, j) if kinds[k] in (HEADLINE, HEAD)]
        if len(run) == 1 and kinds[run[0]] == HEADLINE:
            keep[run[0]] = True
        i = j
    # Below the dive: what is left of a paragraph that was cut, or the rest of a message: one line, or two short ones below one.
    below = [k for k in range(last + 1, n) if kinds[k] in (HEADLINE, HEAD, PROSE, BY)]
    paragraphs = sum(k == PROSE for k in kinds[first : last + 1])
    if len(below) == 1 and kinds[below[0]] == HEADLINE:
        keep[below[0]] = True
    elif paragraphs < WINDOW:
        for k in range(last + 1, min(last + 3, n)):
            if kinds[k] not in (HEADLINE, BY):
                break
            keep[k] = k + 1 >= n or kinds[k + 1] != HEADLINE or k == last + 1 and (k + 2 >= n or kinds[k + 2] != HEADLINE)
    return [i for i in range(n) if not keep[i] and lines[i]]


def last_line(text: str) -> str:
    """What the text's last line is."""
    return _kind(text.rstrip().rpartition("\n")[2].strip())


def article(text: str, site: Collection[int] = ()) -> str:
    """The page's lines without its furniture."""
    drop = set(furniture_lines(text, site))
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)


def site_lines(df: DataFrame) -> DataFrame:
    """(url, text) -> (site, site_lines): per host the hashes of the lines that stand on every other page of it and on five or more.

    A page counts once, however often it was fetched. Counts are made over all pages; a host keeps at most two
    pages' worth of lines.
    """
    pages = df.where("text is not null and text <> ''").select(host(F.col("url")).alias("site"), "url", "text").where("site is not null")
    each = pages.select("site", "url", F.explode(F.split("text", "\n")).alias("line")).select("site", "url", F.xxhash64("line").alias("line")).distinct()
    often = each.groupBy("site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= SITE_PAGES)
    size = pages.select("site", "url").distinct().groupBy("site").agg(F.count("*").alias("of"))
    return often.join(size, "site").where(F.col("n") >= SITE_SHARE * F.col("of")).groupBy("site").agg(F.collect_list("line").alias("site_lines"))


def _with_site(df: DataFrame) -> DataFrame:
    rows = df.where("text is not null and text <> '' and row_id is not null").select("src", "row_id", "url", "text")
    # The sites' lines are broadcast only below Spark's own size limit; beyond it adaptive execution splits hot sites.
    return rows.withColumn("site", host(F.col("url"))).join(site_lines(rows), "site", "left").select("src", "row_id", "text", "site_lines")


@lru_cache(maxsize=1_000)
def _as_set(lines: tuple[int, ...]) -> frozenset[int]:
    return frozenset(lines)


def _dropped(src: str, key: int, text: str, site: list[int] | None):
    for i in furniture_lines(text, _as_set(tuple(site or ()))):
        yield src, key, i


def dropped_lines(df: DataFrame) -> DataFrame:
    """(src, row_id, url, text) -> (src, row_id, line_no) of the lines to drop, each once."""
    return flat_map(_with_site(df), _dropped, "src string, row_id bigint, line_no int", sent(df.sparkSession)).distinct()


def _article(src: str, key: int, text: str, site: list[int] | None):
    yield src, key, article(text, _as_set(tuple(site or ())))


def articles(df: DataFrame) -> DataFrame:
    """(src, row_id, url, text) -> (src, row_id, article), one per row."""
    return flat_map(_with_site(df), _article, "src string, row_id bigint, article string", sent(df.sparkSession))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML pages with text, fetched and cached."""
    f = table(spark, sf_dir, "fetch_results").where("kind = 'html'").select(F.lit("fetch_results").alias("src"), F.col("fetch_id").alias("row_id"), "url", "text")
    c = table(spark, sf_dir, "page_cache").where("kind = 'page' and data.kind = 'html'").select(F.lit("page_cache").alias("src"), F.col("cache_id").alias("row_id"), "url", F.col("data.text").alias("text"))
    return f.unionByName(c)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_lines(pages(spark, sf_dir))


def p4_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return articles(pages(spark, sf_dir)).dropDuplicates(["src", "row_id"])


QUERIES = {"p4_found": p4_found, "p4_articles": p4_articles}
SQL: dict[str, str] = {}
