"""Sentence units of texts in any script, by character-property break rules.

The rules follow the standard sentence break property: terminators of all scripts, closing marks that
follow them, white space, and no break before a small letter. Added are the suppression of abbreviations,
initials and ordinals by language, quotations and bracketed sentences as wholes (a quotation stays with its
reporting clause), dialogue dashes, and spaces as boundaries in Thai, Lao, Khmer and Burmese, which have no terminator.
Matching is done on a copy of the same length in which look-alikes, odd spaces and garbled quotation marks are
plain, so positions hold for the stored string.

Cases: null and blank texts have no sentences; a text without a terminator is one; an unfinished last piece is
one; a quotation or bracket is closed by its mark however far off in its paragraph, and one that is not closed protects the rest of
it only from ``UNCLOSED_CHARS`` on; long texts are walked once, in time proportional to their length; rows sent again give their sentences once.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.confusables import prototypes
from tallymark.llm.encoding import garbled, sent
from tallymark.llm.rows import flat_map
from tallymark.sources.tables import table

# Abbreviations that don't end a sentence, whatever follows.
ABBREVIATIONS = """Mr Mrs Ms Mx Dr Prof Rev Hon Gen Col Maj Capt Cpt Cmdr Lt Sgt Gov Sen Rep Pres St Mt Ft vs cf viz e.g i.e a.k.a approx ca est al fig figs Fig Figs eq
Eq Sect Sec sect ch Ch vol Vol pp p pg ed eds Ave Blvd
Hr Fr Frl bzw vgl z.B d.h u.a o.ä u.U evtl ggf inkl zzgl usf bspw sog Nr Abs Art Kap Bd Mio Mrd Tsd Str Abb Tab Dipl Ing
Mme Mlle MM Me Mgr env p.ex c.-à-d chap éd art réf hab
Sr Sra Srta Dra Dres Lic Ing Prof pág págs aprox núm núms ej p.ej Av Avda cap tel art
Exmo Exma Profa
проф акад доц г-н г-жа ул просп пер стр см напр т.е т.к т.н т.д илл рис табл гл обл им тел тыс млн млрд руб ок
डॉ श्री श्रीमती प्रो सं पृ कृ
د أ م ص ج"""
#: Abbreviations before a number only.
BEFORE_NUMBER = "No Nos no nos Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec n nº"
#: Letters that end a sentence before a capital although they stand alone.
ENDING_LETTERS = "гр"
#: Words of companies that may follow a name ending in an exclamation mark.
COMPANY_WORDS = "Media Inc Ltd Corp Co Group Brands Labs News Mail Japan Holdings Entertainment Records Studios Games"
LEGAL_FORMS = "KG Ltd Inc LLC OHG KGaA"
STARTERS = "The It He She They We I In On At But And If When This That These Those There A An As For However"
#: German words before an ordinal, and words after one.
BEFORE_ORDINAL = "am vom zum im den der dem des das die bis ab seit nach vor zur beim und"
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Abschnitt Kapitel Mal Platz Auflage Etage Stock Klasse Jahrestag Geburtstag Woche"
#: Verbs of reporting clauses, by their beginnings or forms.
SAID = r"\b(?:said|says|told|asked|asks|shouted|cried|wrote|writes|replied|added|explained|insisted|answered|noted|warned|whispered|murmured|argued|declared|recalled|according|sagte|erklärte|fragte|meinte|rief|dit|demanda|déclaré|affirmé|expliqué|a dit|dijo|explicó|preguntó|afirmó|disse|perguntou|afirmou|сказал\w*|заявил\w*|спросил\w*|ответил\w*)\b|कहा|बताया|पूछा|बोले|قال|قالت|أضاف|صرح"
PAIRS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "‹": "›", "(": ")", "（": "）", '"': '"', "＂": "＂", "〈": "〉", "《": "》"}

#: A quotation that nothing closes is one that was cut if it began so near the paragraph's end, else its mark is a stray one.
UNCLOSED_CHARS = 600
#: Behind so many characters of a clause a verb of reporting may belong to a clause within it.
NEAR_CHARS = 60
#: Words after which a verb is not that of the reporting clause.
SUBORDINATE = r"\b(?:because|that|which|when|while|after|before|although|though|if|until|since|but|had|has|have|weil|dass|nachdem|aber|hatte|parce que|qui|que|mais|porque|pero|mas|потому|что|который|но)\b"
_TURN = re.compile(r"\s[—–](?=[^\W\d_])")
_GAP = re.compile(r"\n[ \t\r]*\n\s*")
_END = regex.compile(r"(?:[.…．｡]|\p{Sentence_Break=STerm})+(?:[.…．｡⁠]|\p{Sentence_Break=STerm}|(?:[ ]?[»›](?![\w«]))|[\"'”’)\]）」』】〉》＂])*")
_WIDE_END = frozenset("。！？｡．︒﹒")
_BEFORE = re.compile(r"[^\s()\[\]{}\"“”«»„'’—–,;:/]+$")
_NEXT_WORD = re.compile(r"[^\W\d_][\w\-]*")
_SPACELESS = re.compile(r"[ก-๏຀-ໟក-៓က-႟]")
_OPENERS = "\"'“‘«‹„「『（([{<¿¡—–-•*#>_%@$＂ \t\r\n⁠"


@lru_cache(maxsize=65536)
def _plain_character(c: str) -> str:
    p = prototypes().get(ord(c), c)
    if p is None:
        return "⁠"
    return p if len(p) == 1 and (p.isalnum() or p == " " or p == "-") else c


def same_length(text: str) -> str:
    """A copy of as many characters in which look-alikes are plain, hidden characters are U+2060, and garbled quotation marks are restored."""
    if text.isascii():
        return text
    out = list(text)
    for start, end, original, _, _ in garbled(text):
        if original and any(q in original for q in "“”„«»‘’—…"):
            out[start:end] = original.ljust(end - start, "⁠")[: end - start]
    s = "".join(out)
    for c in set(s):
        # Letters of a word keep their script; only its look-alikes among the other letters turn plain.
        if not c.isascii() and (p := _plain_character(c)) != c and p != "\n":
            s = s.replace(c, p)
    return s


# The lists in the form that texts are matched in.
_ABBR = frozenset(same_length(ABBREVIATIONS).split())
_NUMBERED = frozenset(BEFORE_NUMBER.split())
_COMPANY = frozenset(COMPANY_WORDS.split())
_LEGAL = frozenset(LEGAL_FORMS.split())
_STARTERS = frozenset(STARTERS.split())
_ORDINAL_BEFORE = frozenset(BEFORE_ORDINAL.split())
_ORDINAL_AFTER = frozenset(MONTHS.split())
_ENDING = same_length(ENDING_LETTERS)
_SAID = re.compile(same_length(SAID))
_SUBORDINATE = re.compile(same_length(SUBORDINATE), re.IGNORECASE)
_CLAUSE_END = re.compile(r"[.!?。！？।؟\n]")
_MARKS = re.compile("[" + re.escape("".join(dict.fromkeys("".join((*PAIRS, *PAIRS.values()))))) + "]")
_OPENED_BY = {c: [o for o, closers in PAIRS.items() if c in closers] for closers in PAIRS.values() for c in closers}


def _protected(s: str) -> list[tuple[int, int]]:
    """Spans of quotations and brackets of a paragraph, outermost only."""
    spans: list[tuple[int, int]] = []
    n = len(s)
    opened: list[tuple[str, int]] = []
    count = dict.fromkeys(PAIRS, 0)

    for m in _MARKS.finditer(s):
        c, i = m[0], m.start()
        opener = next((o for o in _OPENED_BY.get(c, "") if count[o]), None)
        if opener:  # what was opened behind it stays open and counts no more
            while True:
                o, at = opened.pop()
                count[o] -= 1
                if o == opener:
                    break
            spans.append((at, i + 1))
        elif c in PAIRS:
            if c in "\"＂" and i and not s[i - 1].isspace() and s[i - 1] not in "(（[—–-…⁠" and s[i - 1].isalnum():
                continue  # an inch sign or a stray closing mark
            if count[c] and c not in "(（":
                continue  # quotations of one kind aren't nested: it goes on
            opened.append((c, i))
            count[c] += 1
    # Cut inside a quotation; a mark further from the end is a stray one.
    spans += [(i, n) for c, i in opened if c not in "(（" and n - i <= UNCLOSED_CHARS]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def _clause(s: str, k: int) -> str:
    """What stands from ``k`` to the end of its clause: a full stop that isn't an abbreviation's, or a line's end."""
    for m in _CLAUSE_END.finditer(s, k):
        if m[0] == ".":
            before = _BEFORE.search(s, max(k, m.start() - 40), m.start())
            token = before[0].replace("⁠", "") if before else ""
            if token in _ABBR or len(token) == 1 and token.isalpha() and token not in _ENDING or s[m.end() : m.end() + 1].isalnum():
                continue
        return s[k : m.start()]
    return s[k:]


def _reports(clause: str) -> bool:
    """Whether a clause is a reporting one: its verb isn't that of a subordinate clause."""
    m = _SAID.search(clause)
    return m is not None and not (m.start() > NEAR_CHARS and _SUBORDINATE.search(clause, 0, m.start()))


def _is_break(s: str, start: int, end: int, mark: str, quoted: bool) -> bool:
    """Whether a sentence ends between ``end`` and the next character that shows. start: where this sentence began."""
    n = len(s)
    wide = mark[0] in _WIDE_END or "ऀ" <= mark[0] <= "෿" or "　" <= mark[0] <= "ヿ"
    k = end
    while k < n and (s[k].isspace() or s[k] == "⁠"):
        k += 1
    if k >= n:
        return True
    spaced = k > end and any(c.isspace() for c in s[end:k])
    if not spaced and not (wide or mark[0] in "！？" or not s[k].isascii() and mark[0] in "।॥؟۔"):
        return False
    j = k
    while j < n and s[j] in _OPENERS:
        j += 1
    follow = s[j] if j < n else ""
    if quoted and mark[-1] not in ".…":  # the terminator stands inside the quotation that closes here
        if wide and not spaced:
            return False  # 「…。」と述べた, “…。”负责人说
        if follow.islower() and follow.isalpha() and unicodedata.category(follow) != "Lo":
            return False
        if mark[0] != "." and s[k] not in "“«„\"「" and _reports(_clause(s, k)):
            return False
    if s[k] in ",;:،、，；：" or s[k] in "—–-" and k + 1 < n and s[k + 1] == " ":
        return False
    if follow.islower() and s[j - 1 : j] not in ("{", "<", "%", "@", "_", "$", "#", "["):
        return False
    if mark[0] in "!" and not quoted:
        word = _NEXT_WORD.match(s, j)
        if word and word[0] in _COMPANY and len(mark) == 1:
            return False
    if mark[0] != "." or len(mark.rstrip("⁠")) > 1 and mark[1] == ".":
        return True
    if len(mark.strip("⁠")) > 1 and mark[0] == "." and mark.strip("⁠")[1] in "\"”’»“)）」":
        return True
    at = end - len(mark)
    m = _BEFORE.search(s, max(start, at - 40), at)
    if not m:
        return True
    token = m[0].replace("⁠", "")
    last = token.rpartition(".")[2]
    word = _NEXT_WORD.match(s[j : j + 40].replace("⁠", ""))
    after = word[0] if word else ""
    if token in _ABBR or last in _ABBR and "." not in token:
        return False
    if token in _NUMBERED:
        return not follow.isdigit()
    if last.isdigit() and "." not in token:
        if len(last) <= 2 and after and j == k:
            before = re.search(r"([^\W\d_]+)\s*$", s[max(start, m.start() - 20) : m.start()])
            if after in _ORDINAL_AFTER or before and before[1].lower() in _ORDINAL_BEFORE:
                return False
        return True
    if token == "Co" and after in _LEGAL:
        return False
    letters = token.split(".")
    if all(len(x) == 1 and x.isalpha() for x in letters) or len(last) == 1 and last.isalpha() and token == last:
        if last in _ENDING and len(letters) == 1:
            return True
        if len(letters) > 1 and last.islower():
            return token not in ("e.g", "i.e", "a.k.a", "z.B", "d.h")
        if len(letters) > 1 and after in _STARTERS:
            return True
        if unicodedata.category(last) == "Lo" and "一" <= last <= "鿿":
            return True
        return not (after or follow.isdigit())
    return True


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence, in code points, without white space at its ends."""
    s = same_length(text)
    out: list[tuple[int, int]] = []

    def put(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))

    at = 0
    for gap in [*_GAP.finditer(s), None]:
        stop = gap.start() if gap else len(s)
        _paragraph(s[at:stop], at, put)
        at = gap.end() if gap else stop
    return out


def _paragraph(s: str, offset: int, put) -> None:
    if not s.strip():
        return
    spans = _protected(s) if re.search(r"[“«„「『‹(（\"＂〈《]", s) else []
    start, span = 0, 0
    dialogue = -1
    # Ends of the dashes that may close a speech, the nearest last.
    turns = [m.end() for m in _TURN.finditer(s)][::-1]
    spaceless = _SPACELESS.search(s) is not None
    ends = list(_END.finditer(s))
    if spaceless:
        cuts = [m for m in re.finditer(r"\s+", s) if m.start() and m.end() < len(s) and _SPACELESS.match(s, m.start() - 1) and _SPACELESS.match(s, m.end())]
    else:
        cuts = []
    marks = sorted([(m.end(), m.start(), m[0]) for m in ends] + [(m.start(), m.start(), "") for m in cuts])
    for end, begin, mark in marks:
        if end <= start:
            continue
        while span < len(spans) and spans[span][1] <= begin:
            span += 1
        quoted = False
        if span < len(spans) and spans[span][0] < begin < spans[span][1]:
            if s[end : spans[span][1]].strip(" ⁠") == "“" and s[spans[span][0]] == "„":
                end, mark = spans[span][1], s[begin : spans[span][1]]
            if end < spans[span][1]:
                continue  # inside
            quoted = True
            if s[spans[span][0]] in "(（":
                quoted = False
        if not mark:
            put(offset + start, offset + end)
            start = end
            continue
        k = start
        while k < end and (s[k].isspace() or s[k] == "⁠"):
            k += 1
        if s[k : k + 1] in "—–" and k + 1 < len(s) and (s[k + 1].isalpha() or s[k + 1] in "¿¡") and dialogue < k:
            while turns and turns[-1] <= k + 2:
                turns.pop()
            dialogue = turns[-1] if turns else (len(s) if len(s) - k < UNCLOSED_CHARS and "\n" not in s[k:] else k)
        if dialogue > end:
            continue
        if _is_break(s, start, end, mark, quoted):
            put(offset + start, offset + end)
            start = end
    put(offset + start, offset + len(s))


def _found(src: str, key: int, text: str):
    for a, b in sentences(text):
        yield src, key, a, b


def _units(src: str, key: int, text: str):
    for n, (a, b) in enumerate(sentences(text)):
        yield src, key, n, text[a:b]


def sentence_spans(df: DataFrame) -> DataFrame:
    """(src, row_id, text) -> (src, row_id, start_pos, end_pos), each once."""
    # Rows sent again are split again and meet in the result, so that no text is shuffled.
    rows = df.where("text is not null and row_id is not null").select("src", "row_id", "text")
    return flat_map(rows, _found, "src string, row_id bigint, start_pos int, end_pos int", sent(df.sparkSession)).distinct()


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of pairs and running texts of pages."""
    p = table(spark, sf_dir, "pairs").select(F.lit("pairs").alias("src"), F.col("pair_id").alias("row_id"), F.col("claim").alias("text"))
    f = table(spark, sf_dir, "fetch_results").where("kind = 'text' and text <> ''").select(F.lit("fetch_results").alias("src"), F.col("fetch_id").alias("row_id"), "text")
    return p.unionByName(f)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans(texts(spark, sf_dir))


def p5_document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of every document: their number per document and the longest one's characters."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.lit("documents").alias("src"), F.col("doc_id").alias("row_id"), "text")
    units = flat_map(d, _units, "src string, doc_id bigint, n int, sentence string", sent(spark))
    return units.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("sentence")).alias("longest"))


QUERIES = {"p5_found": p5_found, "p5_document_sentences": p5_document_sentences}
SQL: dict[str, str] = {}
