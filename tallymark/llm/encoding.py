"""Text decoded with another encoding than it was written in: finding it and restoring it.

For every pair of a written and a reading encoding the garbled forms of character sequences are computed
beforehand and put into one Aho-Corasick automaton. One pass over a text finds them all; only the matched
spans are replaced, so correct text beside them stays. Restoring repeats until nothing more is found, for
texts garbled more than once.

A sequence is kept only if well-formed text can't hold it: several characters of one multi-byte character
(UTF-8 read as something else); a letter that breaks its word by script or case (one-byte encodings of Latin
scripts); three letters in a row that no word has (one-byte encodings of Cyrillic, Arabic, Thai, Greek and Hebrew). Sequences that might
stand in correct text by chance count as weak and need company.

Cases: null and empty texts are not garbled; plain ASCII never is; a lone U+FFFD at the end of a line is where
a text was cut and no case, any other U+FFFD is one, though what it stood for is lost.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Callable
from functools import cache
from itertools import product

import ahocorasick
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.confusables import CYRILLIC_AS, GREEK_AS, MORE, prototypes
from tallymark.llm.rows import first_of_key, flat_map
from tallymark.sources.tables import table

# Encodings that texts are commonly written in or read as.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "cp866")
LATIN_WRITTEN = ("cp1252", "cp1250", "mac_roman", "cp437", "cp850")
CYRILLIC_WRITTEN = ("cp1251", "koi8-r", "cp866", "iso8859-5")
WIDE_READ = ("cp932", "gbk", "big5", "euc-kr")
WIDE_WRITTEN = ("gbk", "big5", "cp932", "euc-kr", "euc-jp")
#: Letters and marks of Latin scripts beyond ASCII, and the twenty most frequent letters of Russian.
LATIN_SMALL = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýßœąćęłńśźżčďěňřšťůžăâșțőű"
MARKS = "“”‘’„–—…«»¡¿"
#: Marks that stand beside letters in correct text.
BESIDE_LETTERS = "«»“”‘’„‚‹›–—…"
RUSSIAN_FREQUENT = "оеаинтсрвлкмдпуязыбг"
#: Other scripts that are written in one byte: their encodings and their most frequent letters and signs.
OTHER_WRITTEN = {
    "ARABIC": (("cp1256", "iso8859-6"), "اليمونرتبةعدسفهكقأ"),
    "THAI": (("cp874",), "านรกเงมยลวดทอสค่้ีัิ"),
    "GREEK": (("cp1253", "iso8859-7"), "αοιετσνηυρπκμλςωάόίέ"),
    "HEBREW": (("cp1255", "iso8859-8"), "יוהלאתמרשבנעםדקחפגטז"),
}
#: Characters that are common in the scripts above, by which restorations are compared.
COMMON = "éèàüäöñóíáçã·•°©" + MARKS + RUSSIAN_FREQUENT[:10] + "".join(x[:10] for _, x in OTHER_WRITTEN.values()) + "のにはをたがでてとしれさいうかなるるんす" + "的一是不了在人有我他中大来上国日年月本会出生同" + "이다는을의에가고하지"
#: Characters that UTF-8 writes in two or three bytes; those of four bytes are found by their form.
SEVERAL_BYTES = ((0x80, 0xD800), (0xF900, 0x10000))

STRONG, RUN, WEAK, LOST, SILENT, TWICE = 3, 2, 1, 0, -1, 4
#: Kinds of signs that no word has inside it, and those of them that may stand beside a word.
SIGNS = ("So", "Sm", "Sk", "Sc", "No", "Lm")
BESIDE_WORDS = "·×°²³¹™®©€£¥¢§¶•±µ"


def _lenient(b: bytes, encoding: str) -> str:
    """Decoding as browsers do: bytes without a character become C1 controls."""
    out = []
    for x in b:
        try:
            out.append(bytes((x,)).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(x))
    return "".join(out)


def _byte(c: str, encoding: str) -> str | None:
    try:
        b = c.encode(encoding)
    except UnicodeEncodeError:
        return None
    return None if len(b) != 1 else b


#: ASCII letters that a letter of another script looks like.
SHARED = frozenset(CYRILLIC_AS + GREEK_AS)


def _script(c: str) -> str:
    """The script of a letter; nothing for letters that two scripts share by their look."""
    if c in SHARED or c not in MORE and (prototypes().get(ord(c)) or "\0").isascii() and ord(c) in prototypes():
        return ""
    return unicodedata.name(c, "?").partition(" ")[0]


def well_formed(s: str) -> bool:
    """Whether a word could hold this run: letters of one script, look-alikes included, in the case of a word."""
    if not all(c.isalpha() and unicodedata.category(c) != "Lo" for c in s):
        return False
    if len({_script(c) for c in s} - {""}) > 1:
        return False
    return s.islower() or s.isupper() or s[1:].islower()


def _seen(c: str) -> bool:
    """Whether a garbled character shows: spaces and formatting also stray into correct text."""
    return unicodedata.category(c)[0] not in "ZC" or "\x80" <= c <= "\x9f"


def _several_bytes(add) -> None:
    for reading in READ_AS:
        signs = [_lenient(bytes((b,)), reading) for b in range(256)]
        for lo, hi in SEVERAL_BYTES:
            for cp in range(lo, hi):
                c = chr(cp)
                if cp >= 0xA0 and unicodedata.category(c) in ("Cn", "Co", "Cs"):
                    continue
                seen = "".join(signs[b] for b in c.encode("utf-8"))
                if well_formed(seen):
                    if len(seen) > 2 or c in LATIN_SMALL or c in LATIN_SMALL.upper():  # no evidence, but replaced inside a broken word
                        add(seen, c, SILENT, "utf-8", reading)
                    continue
                # A capital before a quote or a space, a quote before a letter: correct text has them as well.
                chance = len(seen) == 2 and any(x in BESIDE_LETTERS for x in seen) or len(seen) == 2 and not all(map(_seen, seen))
                add(seen, c, RUN if chance else STRONG, "utf-8", reading)


def _one_byte_latin(add) -> None:
    ascii_small = "abcdefghijklmnopqrstuvwxyz"
    for written in LATIN_WRITTEN:
        for reading in READ_AS:
            for c in dict.fromkeys(LATIN_SMALL + LATIN_SMALL.upper() + MARKS):
                b = _byte(c, written) if len(c) == 1 else None
                if b is None or (g := _lenient(b, reading)) == c or not g.isprintable() or g not in MORE and (prototypes().get(ord(g), g) or "a")[:1].isascii() or not _seen(g):
                    continue
                kind, mark = unicodedata.category(g), c in MARKS
                if g.isalpha() and kind != "Lo":
                    for x in ascii_small:
                        if not mark:
                            if c.islower() and not well_formed(x + g):
                                add(x + g, x + c, STRONG, written, reading)
                            if not well_formed(g + x) and _script(g) not in ("LATIN", ""):
                                add(g + x, c + x, STRONG, written, reading)
                        elif g.islower() and not well_formed(g + x.upper()):
                            add(g + x.upper(), c + x.upper(), STRONG, written, reading)
                        elif g.isupper() and not well_formed(x + g):
                            add(x + g, x + c, STRONG, written, reading)
                    if mark and g.islower():
                        for x in ".,!?":
                            add(x + g, x + c, WEAK, written, reading)
                elif (kind in SIGNS or g in "‰†‡") and not mark:
                    for x in ascii_small:
                        add(x + g, x + c, WEAK, written, reading)
                        if c.isupper():
                            add(g + x, c + x, WEAK, written, reading)
                        else:
                            add(x.upper() + g, x.upper() + c, WEAK, written, reading)


def _signs(add) -> None:
    """A degree, copyright or list sign, a dot between links and an ellipsis, where they usually stand."""
    for written in LATIN_WRITTEN:
        for reading in READ_AS:
            for c in "°©·…•":
                b = _byte(c, written)
                g = _lenient(b, reading) if b else c
                if g == c or not _seen(g) or g in MARKS:
                    continue
                sign = unicodedata.category(g) in ("So", "Sm") and g not in BESIDE_WORDS
                if c == "°" and sign:
                    for x in "CF":
                        add(g + x, c + x, STRONG, written, reading)
                elif c == "©" and sign:
                    for x in "12":
                        add(f"{g} {x}", f"{c} {x}", STRONG, written, reading)
                elif c == "•" and (sign or g.islower()):
                    add(f"\n{g} ", f"\n{c} ", TWICE, written, reading)
                elif c in "·…" and (sign or g.isupper() and _script(g) == "LATIN"):
                    add(f" {g} ", f" {c} ", TWICE, written, reading)


def _one_byte_cyrillic(add) -> None:
    small = RUSSIAN_FREQUENT
    for written in CYRILLIC_WRITTEN:
        for reading in READ_AS:
            if written == reading:
                continue
            to = {c: _lenient(c.encode(written), reading) for c in small + small.upper()}
            for a in small + small.upper():
                for b in small:
                    for c in small:
                        g = to[a] + to[b] + to[c]
                        if not all(map(_seen, g)) or all(x in BESIDE_LETTERS for x in g):
                            continue
                        accents = all(x.isalpha() and unicodedata.name(x, "").startswith("LATIN") for x in g)
                        sign = unicodedata.category(g[0]) in ("So", "Sm", "Sk") and g[0] not in BESIDE_WORDS.replace("®", "")
                        if accents or not well_formed(g) and (sign or not g[1:].islower()):
                            add(g, a + b + c, STRONG, written, reading)


def _one_byte_other(add) -> None:
    for encodings, frequent in OTHER_WRITTEN.values():
        for written in encodings:
            for reading in READ_AS:
                to = {c: _lenient(b, reading) for c in frequent if (b := _byte(c, written)) and _seen(_lenient(b, reading))}
                latin = {c for c, g in to.items() if g.isalpha() and unicodedata.name(g, "").startswith("LATIN")}
                for a, b, c in product(to, repeat=3):
                    g = to[a] + to[b] + to[c]
                    letters = sum(map(str.isalpha, g))
                    if letters == 3 and latin.issuperset((a, b, c)) or letters == 2 and not g[1:].islower() and not any(x in BESIDE_LETTERS for x in g) or letters == 3 and not g[1:].islower() and not well_formed(g):
                        add(g, a + b + c, STRONG, written, reading)


def _read_as_wide(add) -> None:
    """UTF-8 read in an encoding that takes two bytes for a character."""
    kana = [chr(cp) for cp in (*range(0x3041, 0x3094), *range(0x30A1, 0x30FB), 0x3001, 0x3002, 0x30FC)]
    for reading in WIDE_READ:
        for a in kana:
            try:
                seen = a.encode("utf-8").decode(reading)
            except UnicodeDecodeError:
                seen = ""
            if len(seen) == 2 and "\uff61" <= seen[1] <= "\uff9f":  # a rare sign before half a width of kana
                add(seen, a, STRONG, "utf-8", reading)
            for b in kana:
                seen = (a + b).encode("utf-8").decode(reading, "replace").replace("\ufffd", "")
                if len(seen) >= 3:
                    add(seen, a + b, STRONG, "utf-8", reading)
        for c in LATIN_SMALL:
            seen = c.encode("utf-8").decode(reading, "replace")
            if "\ufffd" not in seen and len(seen) == 1:
                for x in "abcdefghijklmnopqrstuvwxyz":
                    add(x + seen, x + c, WEAK, "utf-8", reading)


@cache
def automaton() -> ahocorasick.Automaton:
    """Garbled sequence -> (its length, original, strength, pair of encodings)."""
    found: dict[str, tuple] = {}

    def add(seen: str, original: str, strength: int, written: str, reading: str) -> None:
        if seen.isascii() or seen == original:
            return
        if seen not in found or strength > found[seen][2]:
            found[seen] = (len(seen), original, strength, f"{written}>{reading}")

    _several_bytes(add)
    _one_byte_latin(add)
    _signs(add)
    _one_byte_cyrillic(add)
    _one_byte_other(add)
    _read_as_wide(add)
    add("\ufffd", "", LOST, "?", "utf-8")
    a = ahocorasick.Automaton()
    for seen, what in found.items():
        a.add_word(seen, what)
    a.make_automaton()
    return a


_installed: list[ahocorasick.Automaton] = []
_sent: dict[str, Broadcast] = {}


def _matcher() -> ahocorasick.Automaton:
    """The automaton that was sent to this process, else one made here."""
    return _installed[0] if _installed else automaton()


def sent(spark: SparkSession) -> Callable[[], tuple]:
    """Makes the automaton once per application and sends it out; the result is a ``setup`` that puts it in place in a task's process.

    Its size is fixed (some 10 MB), and reading it takes a tenth of the time that making it does.
    """
    app = spark.sparkContext.applicationId
    if app not in _sent:
        _sent[app] = spark.sparkContext.broadcast(zlib.compress(pickle.dumps(automaton()), 1))
    packed = _sent[app]
    return lambda: _install(packed)


def _install(packed: Broadcast) -> tuple:
    if not _installed:
        _installed.append(pickle.loads(zlib.decompress(packed.value)))
    return ()


@cache
def _four_forms() -> list[tuple[str, frozenset[str], re.Pattern, dict[str, int]]]:
    """Of each reading encoding: the first signs of a character of four bytes, what it looks like, and the bytes of its signs."""
    out = []
    for reading in READ_AS:
        signs = {_lenient(bytes((b,)), reading): b for b in range(0x80, 0x100)}
        lead, rest = ("".join(re.escape(c) for c, b in signs.items() if lo <= b < hi) for lo, hi in ((0xF0, 0xF5), (0x80, 0xC0)))
        first = frozenset(c for c, b in signs.items() if 0xF0 <= b < 0xF5)
        out.append((reading, first, re.compile(f"[{lead}][{rest}]{{3}}"), signs))
    return out


def _four_bytes(text: str) -> list[tuple[int, int, str, int, str]]:
    """Garbled characters of four bytes, of all planes."""
    found, there = [], set(text)
    for reading, first, form, signs in _four_forms():
        for m in form.finditer(text) if not first.isdisjoint(there) else ():
            try:
                c = bytes(signs[x] for x in m[0]).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if unicodedata.category(c) not in ("Cn", "Co", "Cs") and not well_formed(m[0]) and sum(_seen(x) and x not in BESIDE_LETTERS for x in m[0][1:]) >= 2:
                found.append((m.start(), m.end(), c, STRONG, f"utf-8>{reading}"))
    return found


#: Lone small letters of Latin-1 between ASCII ones, neither behind a mark nor before a capital: no sequence is made of such.
_PLAIN = re.compile(r"(?:[\x00-\x7F]|(?<![.,!?])[ßà-öø-ÿ](?![A-Z\x80-\U0010FFFF]))*+")


_LETTERS = re.compile(r"[^\W\d_]+")


class _Runs:
    """The letters in a row around a position, and whether a word could hold them; each run is judged once."""

    def __init__(self, text: str) -> None:
        self.runs = [(m.start(), m.end(), m[0]) for m in _LETTERS.finditer(text)]
        self.starts = [a for a, _, _ in self.runs]
        self.fine: dict[int, bool] = {}

    def well_formed(self, at: int) -> bool:
        k = bisect_right(self.starts, at) - 1
        if k < 0 or at >= self.runs[k][1]:
            return False
        if k not in self.fine:
            self.fine[k] = well_formed(self.runs[k][2])
        return self.fine[k]


def _inside_word(text: str, h: tuple) -> bool:
    """Whether a weak or silent sequence stands where no correct word has it: a sign among letters, a capital behind a small letter."""
    start, end, _, strength, _ = h
    if strength == SILENT:
        return end - start > 1 and text[start].isupper() and text[start - 1 : start].islower() and not text[start].isascii()
    k = next(i for i in range(start, end) if not text[i].isascii())
    c, before, after = text[k], text[k - 1 : k], text[k + 1 : k + 3]
    if unicodedata.category(c) not in SIGNS and c not in "‰†‡" or c in BESIDE_WORDS and c != "±":
        return False
    if before.isascii() and before.isalpha():
        return after[:1].isascii() and after[:1].islower()
    return (not before or before.isspace()) and len(after) == 2 and after.isascii() and after.isalpha() and after.islower() and unicodedata.category(c) in ("So", "Sm", "Sk")


def garbled(text: str) -> list[tuple[int, int, str, int, str]]:
    """(start, end, original, strength, pair) of the garbled sequences; none if all may stand in correct text."""
    if text.isascii() or _PLAIN.fullmatch(text):
        return []
    found = [(e + 1 - n, e + 1, o, s, p) for e, (n, o, s, p) in _matcher().iter(text)] + _four_bytes(text)
    if any(h[3] == SILENT for h in found):
        edges = {x for h in found if h[3] != SILENT for x in h[:2]}
        runs = _Runs(text)
        found = [h for h in found if h[3] != SILENT or h[0] in edges or h[1] in edges or not runs.well_formed(h[0])]
    if any(h[3] == STRONG or h[3] in (WEAK, SILENT) and _inside_word(text, h) for h in found) or sum(h[3] == TWICE for h in found) > 1:
        return found
    lost = [h for h in found if h[3] == LOST]
    if len(lost) > 1 or lost and text[lost[0][1] :].split("\n")[0].strip(" .…[]()"):
        return found
    for reading in READ_AS:  # several in a row
        run = [h for h in found if h[3] == RUN and h[4] == f"utf-8>{reading}"]
        if any(x[1] == y[0] for x, y in zip(run, run[1:], strict=False)):
            return found
    by_pair: dict[str, set[str]] = {}
    for h in found:
        if h[3] == WEAK:
            by_pair.setdefault(h[4], set()).add(text[h[0] : h[1]])
    # Different unlikely sequences of one and the same pair of encodings.
    return found if any(len(v) >= 3 for v in by_pair.values()) else []


def main_pair(found: list[tuple[int, int, str, int, str]]) -> str:
    """The pair of encodings that explains most; several characters for one weigh more."""
    weight: dict[str, float] = {}
    for start, end, _, strength, pair in found:
        weight[pair] = weight.get(pair, 0) + (strength > LOST) * (end - start) * (1.5 if pair.startswith("utf-8") else 1)
    return max(sorted(weight), key=weight.__getitem__)


@cache
def _signs_of(reading: str) -> dict[str, int]:
    """Sign beyond ASCII -> its byte."""
    return {_lenient(bytes((b,)), reading): b for b in range(128, 256)}


def _redecoded(unit: str, written: str, reading: str) -> str | None:
    """A piece of text read again in the encoding it was written in; None where its signs or bytes don't allow it."""
    if reading in WIDE_READ:
        try:
            raw = unit.encode(reading)
        except UnicodeEncodeError:
            return None
    else:
        signs = _signs_of(reading)
        if any(c not in signs for c in set(unit) if not c.isascii()):
            return None
        raw = bytes(signs.get(c) or ord(c) for c in unit)
    if written in ("utf-8", *WIDE_WRITTEN):
        try:
            return raw.decode(written)
        except UnicodeDecodeError:
            return None
    return "".join(chr(b) if b < 128 else _upper_half(written)[b - 128] for b in raw)


@cache
def _upper_half(written: str) -> str:
    return "".join(_lenient(bytes((b,)), written) for b in range(128, 256))


@cache
def _fine_run(run: str) -> bool:
    return well_formed(run) or all(unicodedata.category(c) in ("Lo", "Lm", "Mn", "Mc") for c in run)


_INSIDE = re.compile(r"[^\W_]+")
_ACCENTS = re.compile(r"[À-ÖØ-öø-ɏ]{3}")


def _bad(token: str) -> bool:
    """Whether no text has this between two spaces: an ill-formed word, three accents in a row, or a sign or control among letters."""
    if token.isascii():
        return False
    if _ACCENTS.search(token):
        return True
    if not all(_fine_run(x) for m in _INSIDE.finditer(token) for x in re.findall(r"[^\W\d_]+", m[0])):
        return True
    for i, c in enumerate(token):
        kind = unicodedata.category(c) if not c.isascii() else ""
        if kind in ("Cc", "Co", "Cn") or kind in SIGNS and c not in BESIDE_WORDS and (token[i - 1 : i].isalpha() or token[i + 1 : i + 2].isalpha()):
            return True
    return False


def _n_bad(text: str) -> int:
    return sum(map(_bad, re.split(r"[ \t\r\n]+", text)))


def _pieces(text: str, hits: list, written: str, reading: str) -> str:
    """The lines that hold garbled sequences read again as wholes where that leaves nothing bad, else their bad words alone."""
    out, at, marked = [], 0, [h[:2] for h in hits]
    starts = sorted(marked)
    for line in text.split("\n"):
        end = at + len(line)
        k = bisect_right(starts, (end, end))
        touched = k > 0 and starts[k - 1][1] > at or not line.isascii() and _n_bad(line) > 0
        made = _redecoded(line, written, reading) if touched else None
        if made is not None and (written == "utf-8" or not _n_bad(made)) and "\n" not in made:
            out.append(made)
        elif touched:
            inside = {x for a, b in starts if a < end and b > at for x in range(a - at, b - at)} if written == "utf-8" else set()
            words, here = [], 0
            for w in re.split(r"([ \t\r]+)", line):
                wanted = not inside.isdisjoint(range(here, here + len(w))) or _bad(w)
                again = _redecoded(w, written, reading) if wanted else None
                words.append(again if again is not None and (written == "utf-8" or not _bad(again)) else w)
                here += len(w)
            out.append("".join(words))
        else:
            out.append(line)
        at = end + 1
    return "\n".join(out)


def _spans(text: str, hits: list, pair: str) -> str:
    """The matched sequences of one pair replaced, and nothing else."""
    out, at = [], 0
    for start, end, original, _, p in sorted(hits, key=lambda h: (h[0], -h[1])):
        if p == pair and start >= at:
            out += [text[at:start], original]
            at = end
    return "".join(out) + text[at:]


def _common(text: str) -> int:
    low = text.lower()
    return sum(map(low.count, COMMON))


def _score(text: str) -> tuple[int, int]:
    return _n_bad(text), -_common(text)


def _restored_once(text: str, hits: list) -> str:
    pair = main_pair(hits)
    written, _, reading = pair.partition(">")
    if written == "utf-8":
        made = _pieces(text, hits, written, reading)
        left = [h for h in garbled(made) if h[4] == pair and h[3] != LOST]
        return _spans(made, left, pair) if left else made
    # Encodings of one byte share many sequences: the pair that leaves the fewest bad words and the commonest letters.
    tried = {h[4]: None for h in hits if not h[4].startswith(("utf-8", "?"))}
    # Readings that have the signs of some match.
    matched = {text[h[0] : h[1]] for h in hits}
    readings = [r for r in READ_AS if any(all(c.isascii() or c in _signs_of(r) for c in m) for m in matched)]
    tried |= {f"{w}>{r}": None for w in (*CYRILLIC_WRITTEN, *(w for e, _ in OTHER_WRITTEN.values() for w in e)) for r in readings if w != r}
    best = min((_pieces(text, hits, *p.split(">")) for p in tried), key=_score)
    return best if best != text and _score(best) < _score(text) else _spans(text, hits, pair)


def restore(text: str) -> str:
    """The text with what was garbled read again, one pair of encodings after the other; what was lost stays U+FFFD."""
    first, seen, made = None, set(), text
    while made not in seen:
        seen.add(made)
        hits = [h for h in garbled(made) if h[3] != LOST]
        if not hits:
            break
        first = first or hits
        made = _restored_once(made, hits)
    if not first or not _n_bad(made):
        return made
    # Bytes of two-byte encodings look like others' by chance: they are asked last, and must leave nothing bad.
    wide = [_pieces(text, first, w, r) for w in WIDE_WRITTEN for r in ("cp1252", "latin-1")]
    return min([made, *(x for x in wide if not _n_bad(x) and 10 * _common(x) >= sum(not c.isascii() for c in x))], key=_score)


def _found(key: int, text: str):
    if garbled(text):
        yield (key,)


def _restored(key: int, text: str):
    found = garbled(text)
    if found:
        made = restore(text)
        yield key, made, len(found), main_pair(found), "\ufffd" not in made and not garbled(made)


def garbled_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """Keys of the rows whose text is garbled, wholly or in part; each key once."""
    rows = df.where(F.col(text).isNotNull() & F.col(text).rlike(r"[^\x00-\x7F]")).select(key, text)
    return flat_map(rows, _found, f"{key} bigint", sent(df.sparkSession)).distinct()


def restored(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, restored, n_spans, pair, complete) of the garbled rows; nothing for the others."""
    rows = df.where(F.col(text).isNotNull() & F.col(text).rlike(r"[^\x00-\x7F]")).select(key, text)
    return flat_map(rows, _restored, f"{key} bigint, restored string, n_spans int, pair string, complete boolean", sent(df.sparkSession))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_keys(table(spark, sf_dir, "fetch_results"), "fetch_id", "text")


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled fetch results with their restored text; rows sent again once."""
    return first_of_key(restored(table(spark, sf_dir, "fetch_results"), "fetch_id", "text"), "fetch_id")


QUERIES = {"p2_found": p2_found, "p2_restored": p2_restored}
SQL: dict[str, str] = {}
