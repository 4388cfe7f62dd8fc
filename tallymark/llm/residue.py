"""Template residue, filler and error-page text instead of, or amid, real content.

Placeholders are found by one grammar per delimiter, unrendered values and filler by expressions. What is found is weighed
against its surroundings, by structure: it is shown, not left over, if it stands in quotation marks or code, behind a word that
names such things (`the word`, `a placeholder`), or as the object of a verb of writing or showing in a sentence that names
such things. Delimiters that prose uses as well (one pair of braces or brackets) count for a name of a field, braces also beside other
ones on the page. Code blocks don't count, nor pages that are largely code. A page is an error or script
notice if its own content, without the site's furniture, is one: such messages lead it and hardly any other prose stands beside them.

Cases: null and empty texts have no residue; whole texts are read, however long; status and kind are not asked;
rows sent again count once.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.boilerplate import BY, HEADLINE, _kind, fold, furniture_lines
from tallymark.llm.confusables import skeleton
from tallymark.llm.encoding import sent
from tallymark.llm.rows import first_of_key, flat_map
from tallymark.sources.tables import table

_NAME = r"[A-Za-z_][\w.\-]*(?:\[\w+\])*"
#: Delimiter -> grammar of an unfilled placeholder.
GRAMMARS = {
    "{{ }}": rf"\{{\{{\{{?\s*[#/^&>]?\s*{_NAME}(?:\s*\|\s*{_NAME}(?::[^{{}}]*)?)*\s*\}}?\}}\}}",
    "{% %}": r"\{%-?\s*\w+[^{}%]*-?%\}",
    "${ }": rf"\$\{{\s*{_NAME}(?:\(\))?\s*\}}",
    "#{ }": rf"#\{{\s*{_NAME}\s*\}}",
    "<% %>": rf"<%[=\-#]?\s*{_NAME}[^<>%]*%>",
    "<< >>": rf"<<\s*{_NAME}\s*>>|«[A-Za-z]\w*[_.]\w+»",
    "%% %%": rf"%%\s*{_NAME}\s*%%",
    "@@ @@": rf"@@\s*{_NAME}\s*@@",
    "__ __": r"(?<!\w)__[A-Za-z][A-Za-z0-9.]*(?:_[A-Za-z0-9.]+)*__(?!\w)",
    "$ $": r"(?<![\w$])\$[A-Za-z][\w.]{2,}\$(?![\w$])",
    "*| |*": rf"\*\|\s*{_NAME}\s*\|\*",
    "[[ ]]": rf"\[\[\s*{_NAME}\s*\]\]",
    "[ ]": r"\[(?:INSERT|YOUR|ENTER|ADD|TODO|TBD|TK)\b[^\]\n]*\]|\[[A-Z]{2,}(?:[ _.][A-Z]{2,})+\](?!\()|\[(?:insert|your|enter|add) [^\]\n]{2,}\]",
    "% %": r"(?<![\w%])%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+%(?![\w%])|%\([a-z_]\w*\)[sd]",
    "X": r"\bX{3}[-. ]X{3,4}(?:[-. ]X{2,4})?\b|\b(?:name|user|email|info)@(?:yourdomain|yoursite|yourcompany|domain)\b",
}
#: Forms that prose and formulas have as well: they count for a field's name, braces also where the page has several.
WEAK = {"{ }": r"(?<![\w$#{}\\])\{\s*(\d{1,2}|[A-Za-z][\w.]*)\s*\}(?!\})", "[ ]": r"(?<![\w\]])\[([A-Z]{3,})\](?!\()"}
# Common names of fields in templates.
FIELDS = """name firstname lastname fullname username user title date pubdate updated lastupdated modified time year email mail phone address street city town region country state zip company author editor
price amount total currency id number count section category headline tagline subject quote url link image caption text body description summary intro product item price order issue status noun adjective verb""".split()
#: Values that were never rendered.
VALUES = r"\[object (?:Object|Array|Undefined|HTML\w+)\]|\bInvalid Date\b|(?:[:=]|\bis|\bby|\bon|\bfrom|\bof|\bfor|\bto|\bat) (?:undefined|NaN|null)\b|\b(?:undefined|NaN|null) (?:minutes?|hours?|days?|views?|items?|results?|comments?|stars?|undefined|null|NaN|\d)\b|\$(?:NaN|undefined)\b"
# Words of the usual filler Latin, and phrases that hold the place of a text.
FILLER_WORDS = """ad adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt do dolor dolore duis ea eiusmod elit enim esse est et eu
ex excepteur exercitation fugiat id in incididunt ipsum irure labore laboris laborum lorem magna minim mollit nisi non nostrud nulla occaecat officia pariatur proident qui quis
reprehenderit sed sint sit sunt tempor ullamco ut velit veniam voluptate"""
FILLER = r"""\b(?:text|description|content|title|headline|copy|caption|bio|summary) goes here\b|\bplaceholder (?:paragraph|text|copy|content|headline|title)\b
\b(?:sample|dummy|filler|example) (?:text|copy|content)(?: used| to show|[,.:]| here)|\b(?:click|tap|double-click) (?:here )?to (?:edit|add)\b|^todo ?[:\-]|^tbd\b|^fixme\b
\bto be (?:written|supplied|added later)\.?$|\breplace (?:this|the) (?:paragraph|text|sentence|copy)\b|\b(?:add|write|type|insert|enter|put) your (?:own )?(?:text|copy|content|title|story) here\b|\bcoming soon\W*$
\bblindtext\b|\bplatzhalter(?:text)?\b|\b(?:hier steht|hier kommt) (?:ihr|dein|der) text\b|\bmustertext\b
\btexte (?:d[’']exemple|de remplissage|à remplacer|factice)\b|\bfaux texte\b|\bvotre texte ici\b
\btexto de (?:ejemplo|relleno|muestra|prueba|exemplo|preenchimento)\b|\b(?:escriba|escribe|coloque|insira|insiera) (?:aquí|aqui|su|seu|tu) .{0,20}texto\b|\bsu texto aquí\b|\bseu texto aqui\b
\b(?:пример текста|образец текста|текст-заполнитель|текст-рыба|рыба-текст|здесь будет текст|введите текст)\b
示例文本|占位(?:文本|文字|符)|此处(?:填写|输入|添加|为)|请在此(?:输入|处)|这里是(?:示例|正文)|ダミー(?:テキスト|文章|の文)|サンプル(?:テキスト|文章)|ここに.{0,12}(?:入力|記入|入ります|挿入)|仮の?(?:テキスト|文章)
नमूना पाठ|यहाँ (?:अपना )?पाठ|نص (?:تجريبي|بديل|مؤقت)|أدخل النص|ข้อความ(?:ตัวอย่าง|จำลอง)|ใส่ข้อความ"""
#: Messages of servers, browsers and checks, at the start of a sentence.
ERRORS = r"""(?:http )?(?:error )?[45]\d\d\b(?: ?[-:–] ?| )?(?:not found|forbidden|unauthorized|internal|bad gateway|bad request|service|gateway|gone|error|too many|method|page)|error [45]\d\d\b|(?:internal server|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)\b.{0,25}$
bad gateway|not found$|page (?:not found|introuvable|non trouvée)|(?:the|this|that) (?:page|story|article|content|file|resource|document|link) (?:you (?:are looking|requested|were looking)|(?:is|was) (?:no longer|not|currently un)|(?:could|can)(?: ?no|n[’'])t be|has (?:been (?:removed|moved|deleted)|expired|moved)|may have|doesn[’']t exist|does not exist)|oops\b|(?:we|sorry, we) (?:can[’']?t|cannot|could ?n[o’']t|couldn[’']t) (?:find|load|display|reach|process)|sorry, (?:this|the|that|something|an|but) .{0,40}(?:could not|couldn[’']t|cannot|can[’']t|is not|isn[’']t|not available|went wrong|unavailable)|something went wrong|an? (?:unexpected |internal |unknown )?error (?:has )?occurred|the server (?:encountered|is (?:temporarily|overloaded|down|not)|did not|could not|returned)|the upstream (?:host|server)|the requested (?:url|page|resource)|the (?:site|service|website) is (?:temporarily|currently|down)|our (?:site|servers?|service) (?:is|are) (?:down|currently|temporarily|under|undergoing)|we[’'](?:ll| will) be (?:right )?back|(?:down for |under |scheduled )maintenance|fatal error|parse error|uncaught (?:exception|error|typeerror)|stack trace|traceback \(most|warning: (?:mysql|include|require|undefined)|error establishing|database (?:connection )?error|unable to connect|connection (?:timed out|refused|reset)|request timed? ?out
access (?:denied|to this (?:page|site|resource))|you (?:don[’']t|do not) have (?:permission|access)|forbidden$|permission denied|you have been blocked|your (?:ip|request) (?:address )?(?:has been|was) (?:blocked|denied)|too many requests|slow down and|rate limit|your session (?:has )?(?:expired|timed out)|(?:please )?log ?in again|please (?:reload|refresh|try again)
javascript (?:is|must be|required|seems)|(?:please |you need to |you must |you have to )?(?:enable|turn on|activate) (?:javascript|scripts|cookies)\b|turn it on in|if nothing happens|this (?:application|app|site|page|website) (?:requires|needs) (?:javascript|scripts)|your browser (?:does not|doesn[’']t|is (?:not|out))|checking (?:your|if the) (?:browser|site connection|connection)|this process is automatic|verify(?:ing)? (?:that )?you are (?:a )?human|please (?:verify|wait|stand by|complete)|one (?:more )?(?:moment|step)|just a moment|are you a robot|unusual traffic|complete the captcha
seite nicht gefunden|die (?:angeforderte |gewünschte )?seite (?:existiert|wurde|konnte|ist)|bitte aktivieren sie|javascript (?:ist|muss)|zugriff verweigert|fehler [45]\d\d|interner serverfehler|ein fehler ist
page introuvable|le contenu demandé|la page (?:demandée|que vous)|(?:veuillez|merci de) (?:activer|patienter|réessayer)|accès refusé|erreur [45]\d\d|une erreur
página no encontrada|la página (?:solicitada|que busca|no existe)|active javascript|habilite javascript|acceso denegado|error [45]\d\d|lo sentimos
página não encontrada|a página (?:solicitada|que)|ative o javascript|habilite o javascript|acesso negado|erro [45]\d\d|ocorreu um erro
страница не найдена|проверьте адрес|включите javascript|доступ (?:запрещ|закрыт)|ошибка [45]\d\d|произошла ошибка|запрашиваемая страница
お探しのページ|ページが見つかりません|.{0,20}javascriptを有効|アクセスが拒否|エラーが発生|您访问的页面|页面不存在|找不到(?:该|页面)|.{0,12}请(?:启用|开启|打开)\s*javascript|访问被拒绝|服务器(?:内部)?错误|系统(?:错误|维护)
पृष्ठ नहीं मिला|कृपया javascript|الصفحة (?:غير موجودة|المطلوبة|التي)|يرجى تفعيل|ไม่พบหน้า|กรุณาเปิดใช้งาน|เกิดข้อผิดพลาด"""
#: Lines that servers put below their messages.
TRAILERS = r"incident id|error code|reference #|request id|ray\b|host:|nginx|nginy|apache|loading\W*$|go back to|return to the home|try the search|if the problem persists|contact the site|client ip|trace id"
# Words that name such things, and verbs that have what is written or shown as their object.
NAMING = r"\b(?:placeholders?|variables?|templates?|syntax|notations?|markers?|tokens?|tags?|merge fields?|strings?|markup|source code|code samples?|examples?|e\.g\.|documentation|tutorials?|developers?|programmers?|filler|dummy text|platzhalter|variablen?|vorlagen?|beispiele?|entwickler|variables|modèles?|exemples?|développeurs|plantillas?|ejemplos?|desarrolladores|marcadores|modelos?|exemplos?|desenvolvedores|шаблон\w*|переменн\w*|пример\w*)\b|模板|变量|占位符|テンプレート|変数|例"
BEHIND = r"\b(?:words?|strings?|phrases?|terms?|tokens?|placeholders?|markers?|notations?|variables?|tags?|characters|text|such as|e\.g\.|for example,?|like|called|wort|platzhalter|mot|palabra|palavra|слово)[:\s]*$"
SHOWING = r"\b(?:writes?|wrote|written|types?|typed|uses?|used|shows?|showed|shown|displays?|displayed|prints?|printed|inserts?|puts?|means?|meant|schreiben|schreibt|zeigt|zeigen|écrivent|écrit|montre|escriben|escribe|muestra|escrevem|mostra)[:\s]*$"

_GRAMMAR = re.compile("|".join(f"(?:{g})" for g in GRAMMARS.values()))
_VALUES = re.compile(VALUES)
_FILLER = re.compile(skeleton(FILLER.replace("\n", "|")))
_ERROR = re.compile(r"^\W*(?:" + skeleton(ERRORS.replace("\n", "|")) + ")")
_TRAILER = re.compile(r"^\W*(?:" + TRAILERS + ")")
_WEAK = [re.compile(p) for p in WEAK.values()]
_BRACES = _WEAK[0]
_NAMING = re.compile(skeleton(NAMING))
_BEHIND = re.compile(skeleton(BEHIND))
_SHOWING = re.compile(skeleton(SHOWING))
_FIELD = re.compile("(?:" + "|".join(FIELDS) + r")s?\d*")
_OPENING, _CLOSING = "\"'“‘„‚«‹「『`", "\"'”’“‘»›」』`"
_AND = re.compile(r"[\"'”’»]?\s*(?:[,/]|,?\s*(?:and|or|und|oder|et|ou|y|o))\s*[\"'“‘«]?")
_ASCII_WORD = re.compile(r"[a-z]+")
_LATIN_FILLER = frozenset(FILLER_WORDS.split())
_SENTENCE = re.compile(r"[^.!?。！？।؟\n]*(?:[.!?](?=[\w{\[<%@#$_])[^.!?。！？।؟\n]*)*[.!?。！？।؟\n]*[\"”’»“]*")
_INLINE_CODE = re.compile(r"`[^`\n]+`")
#: Every phrase of filler holds one of these.
_FILLER_KEYS = tuple(skeleton(x) for x in "here hier placeholder text copy content click tap todo tbd fixme written supplied later replace coming platzhalter exemple remplissage remplacer factice ejemplo relleno muestra prueba exemplo preenchimento texto текст рыба 示例 占位 此处 请在此 这里是 ダミー サンプル ここに 仮 नमूना यहाँ نص أدخل ข้อความ".split())
_MAYBE = re.compile(r"[«{}<>\[\]%@#$]|__|XXX|@|undefined|NaN|null|Invalid Date")
#: Share of code from which a page is a tutorial; a sentence without a message that is no longer is a label.
#: Other sentences for each message, at most: what a notice says to explain itself.
TUTORIAL, LABEL_CHARS, EXPLAINED = 0.2, 45, 2


def without_code(text: str) -> str:
    """The text without code blocks and spans; a fence or tag that isn't closed opens none."""
    for opening, closing in (("```", "```"), ("~~~", "~~~"), ("<pre", "</pre>"), ("<code", "</code>")):
        if opening not in text:
            continue
        out, at, low = [], 0, text.lower()
        while (a := low.find(opening, at)) >= 0 and (b := low.find(closing, a + len(opening))) >= 0:
            out.append(text[at:a])
            at = b + len(closing)
        text = " ".join([*out, text[at:]])
    return _INLINE_CODE.sub(" ", text) if "`" in text else text


def _sentences(line: str) -> list[str]:
    return [s.strip() for s in _SENTENCE.findall(line) if s.strip()]


def _is_filler_latin(words: list[str]) -> bool:
    return len(words) >= 5 and sum(map(_LATIN_FILLER.__contains__, words)) >= 0.8 * len(words)


def _shown(s: str, found: list[re.Match]) -> bool:
    """Whether everything that was found in a sentence is shown or quoted there rather than left over."""
    naming, last = None, None
    for m in found:
        before, after = s[: m.start()].rstrip(), s[m.end() :].lstrip()
        quoted = before[-1:] in _OPENING and after[:1] in _CLOSING and before and after
        listed = last is not None and _AND.fullmatch(s, last.end(), m.start())
        last = m
        if quoted or listed:
            continue
        f = fold(s[: m.start()])
        if _BEHIND.search(f):
            continue
        if naming is None:
            rest, at = [], 0
            for x in found:
                rest.append(s[at : x.start()])
                at = x.end()
            naming = _NAMING.search(fold(" ".join([*rest, s[at:]]))) is not None
        if not (naming and _SHOWING.search(f)):
            return False
    return True


def _is_field(name: str) -> bool:
    """Whether a name, or its first or last part, is that of a field."""
    parts = re.split(r"[_.\s]|(?<=[a-z])(?=[A-Z])", name)
    return any(_FIELD.fullmatch(x.lower()) for x in (parts[0], parts[-1], "".join(parts)))


@lru_cache(maxsize=50_000)
def sentence_residue(s: str) -> str | None:
    """Kind of residue in a sentence: placeholder, value, filler; None if there is none or it is only shown."""
    f = fold(s)
    if _MAYBE.search(s):
        for kind, grammar in (("placeholder", _GRAMMAR), ("value", _VALUES)):
            if (found := list(grammar.finditer(s))) and not _shown(s, found):
                return kind
        found = [m for p in _WEAK for m in p.finditer(s) if _is_field(m[1])]
        if found and not _shown(s, found):
            return "placeholder"
    if _is_filler_latin(_ASCII_WORD.findall(f)):
        return "filler"
    if any(k in f for k in _FILLER_KEYS) and (found := list(_FILLER.finditer(f))) and not _shown(f, found):
        return "filler"
    return None


def _several_weak(sentences: list[str]) -> bool:
    """Whether different names stand in single braces on the page, not only shown; abbreviations in brackets say nothing by their number."""
    names: set[str] = set()
    for s in sentences:
        if "{" in s and (found := list(_BRACES.finditer(s))) and not _shown(s, found):
            names.update(m[1] for m in found)
    return len(names) > 1


@lru_cache(maxsize=50_000)
def is_message(s: str) -> bool:
    """Whether a sentence is an error, check or script message itself."""
    return bool(_ERROR.search(fold(s)))


def residue(text: str, html: bool) -> str | None:
    """Kind of residue a page holds: placeholder, value, filler or notice; None for a page of real content."""
    drop = set(furniture_lines(text)) if html else ()
    lines = [x.strip() for i, x in enumerate(text.split("\n")) if i not in drop and x.strip()]
    if not lines:
        return None
    whole = "\n".join(lines)
    plain = without_code(whole)
    if len(whole) - len(plain) <= TUTORIAL * len(whole):
        said = [s for line in plain.split("\n") for s in _sentences(line)]
        for s in said:
            if (kind := sentence_residue(s)) is not None:
                return kind
        if _several_weak(said):
            return "placeholder"
    # Messages and other sentences; labels and what servers put below their messages count for neither.
    messages = prose = 0
    for line in lines:
        label = _kind(line) in (HEADLINE, BY)
        for s in _sentences(line):
            if is_message(s):
                messages += 1
            elif not label and not _TRAILER.search(s.lower()) and (len(s) > LABEL_CHARS or re.search(r"[ऀ-￿]{12}", s)):
                prose += 1
        if prose and not messages:
            return None
    return "notice" if messages and EXPLAINED * messages >= prose else None


def _found(key: int, text: str, kind: str):
    what = residue(text, kind == "html")
    if what:
        yield key, what


def residue_rows(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(key, residue) of the rows that hold residue; a key sent again once per kind of residue."""
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(key).isNotNull()).select(key, text, kind)
    return flat_map(rows, _found, f"{key} bigint, residue string", sent(df.sparkSession)).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_rows(table(spark, sf_dir, "fetch_results"), "fetch_id", "text", "kind").select("fetch_id").distinct()


def p3_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per kind of residue."""
    return first_of_key(residue_rows(table(spark, sf_dir, "fetch_results"), "fetch_id", "text", "kind"), "fetch_id").groupBy("residue").agg(F.count("*").alias("n"))


QUERIES = {"p3_found": p3_found, "p3_kinds": p3_kinds}
SQL: dict[str, str] = {}
