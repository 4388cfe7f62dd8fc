"""One form for texts that look alike: a confusables skeleton, and the rows that share one.

The skeleton decomposes a text, replaces every character by its prototype, and decomposes again. The
prototypes come from the character data that Python carries (full and half width, presentation and font
forms, ligatures, spaces, characters that don't show) and from one table of look-alike letters. Case,
accents, raised figures, line breaks, words and punctuation stay, for they are seen.

Cases: null, empty and blank strings (also those of invisible characters only) have no skeleton and pair
with nothing; very long texts are taken whole; rows sent again count once; equal strings are no pair.
"""

from __future__ import annotations

import hashlib
import unicodedata
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.rows import flat_map
from tallymark.session import cut
from tallymark.sources.tables import table

# Letters of other scripts and the Latin letters they look like, place by place.
CYRILLIC = "АВЕЅІЈКМНОРСТУХԌԚԜҮһаԁеѕіјорсухԛԝү"
CYRILLIC_AS = "ABESIJKMHOPCTYXGQWYhadesijopcyxqwy"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳινοϲ"
GREEK_AS = "ABEZHIKMNOPTYXCjivoc"
LATIN = "ɑɡıʏᴠᴡᴢ‐‑"
LATIN_AS = "agiyvwz--"

# Letters and marks of further scripts and what they look like, place by place, as in Unicode's confusables.
GREEK_MORE, GREEK_MORE_AS = "αγρσυ", "aypou"
CYRILLIC_MORE, CYRILLIC_MORE_AS = "ЬьгѵѴԌԍѡӏӀӔӕ", "bbrvVGgwlIÆæ"
ARMENIAN, ARMENIAN_AS = "ՍՏՕԼաոսհցզքյօ", "USOLwnuhgqfjo"
CHEROKEE, CHEROKEE_AS = "ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏃᏎᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏮᏴ", "DRTiyAJEWMHYGZ4RWSVSLCPKd6B"
COPTIC, COPTIC_AS = "ⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬⲌ", "HIKMNOoPpCcTYXZ"
LISU, LISU_AS = "ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU"
LATIN_MORE, LATIN_MORE_AS = "ȷɩɪʋꜱᴄᴏᴜ", "jiiuscou"
MARKS, MARKS_AS = "․‚∶ʼǃ∕⁄", ".,:’!//"

#: Kinds of compatibility mapping that keep a character's look. Raised, lowered, circled and squared forms don't.
_ALIKE = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
_PLANES = (range(0x80, 0x20000), range(0xE0000, 0xE0200))


MORE = GREEK_MORE + CYRILLIC_MORE + ARMENIAN + CHEROKEE + COPTIC + LISU + LATIN_MORE + MARKS
MORE_AS = GREEK_MORE_AS + CYRILLIC_MORE_AS + ARMENIAN_AS + CHEROKEE_AS + COPTIC_AS + LISU_AS + LATIN_MORE_AS + MARKS_AS


@cache
def prototypes() -> dict[int, str | None]:
    """Code point -> what stands for it in a skeleton; None for nothing."""
    out: dict[int, str | None] = {}
    for plane in _PLANES:
        for cp in plane:
            ch = chr(cp)
            category = unicodedata.category(ch)
            if category == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0):
                out[cp] = None
            elif category == "Zs":
                out[cp] = " "
            elif category not in ("Cn", "Co", "Cs"):
                kind, _, rest = unicodedata.decomposition(ch).partition(" ")
                if kind in _ALIKE or kind == "<compat>" and category[0] in "LN":
                    made = unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in rest.split()))
                    if not made.startswith(" "):
                        out[cp] = made
    letters = str.maketrans(CYRILLIC + GREEK + LATIN + MORE, CYRILLIC_AS + GREEK_AS + LATIN_AS + MORE_AS)
    plain = {cp: chr(p) if isinstance(p, int) else p for cp, p in letters.items()}
    return {cp: p if p is None else p.translate(letters) for cp, p in out.items()} | plain


@cache
def _by_character() -> dict[str, str]:
    return {chr(cp): p or "" for cp, p in prototypes().items()}


def skeleton(text: str) -> str:
    """The form in which texts that look alike are equal."""
    if text.isascii():
        return text
    text, to = unicodedata.normalize("NFD", text), _by_character()
    for c in to.keys() & set(text):
        text = text.replace(c, to[c])
    return unicodedata.normalize("NFD", text)


def _digests(src: str, key: int, text: str):
    s = skeleton(text)
    if s and not s.isspace():
        yield src, key, hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest(), hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def digests(df: DataFrame) -> DataFrame:
    """(src, key, text) -> (src, key, skeleton, string): digests of 128 bits, one row per row and string."""
    rows = flat_map(df.where("text is not null and key is not null").select("src", "key", "text"), _digests, "src string, key bigint, skeleton binary, string binary")
    return rows.distinct()


def classes(df: DataFrame) -> DataFrame:
    """One row per (src, key): the class of its skeleton, the class's size and its number of spellings."""
    d = cut(digests(df))
    sizes = d.groupBy("src", "skeleton", "string").agg(F.count("*").alias("n")).groupBy("src", "skeleton").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_spellings"))
    return d.join(sizes, ["src", "skeleton"]).select("src", "key", F.hex("skeleton").alias("class_id"), "n_rows", "n_spellings")


def look_alikes(df: DataFrame) -> DataFrame:
    """(src, key, text) -> (src, key_a, key_b): rows whose strings differ but have one skeleton.

    Copies of one string never meet each other: spellings are paired first, and their rows are put to
    them afterwards, so the work is that of the result and of the spellings. The result itself is that of all pairs: where two
    spellings of one text are held by a and b rows it has a times b of them. ``classes`` says the same in one row per row. A spelling
    held by a third of all rows is a hot key of the last two joins, which adaptive execution broadcasts or splits.
    """
    d = cut(digests(df))  # keys and digests, written once: skeletons are made once
    several = d.groupBy("src", "skeleton").agg(F.min("string").alias("_a"), F.max("string").alias("_b")).where("_a <> _b").select("src", "skeleton")
    rows = d.join(several, ["src", "skeleton"], "left_semi")
    spelt = rows.select("src", "skeleton", "string").distinct()
    a, b = spelt.withColumnRenamed("string", "string_a"), spelt.withColumnRenamed("string", "string_b")
    pairs = a.join(b, ["src", "skeleton"]).where("string_a < string_b").select("src", "string_a", "string_b")
    left = rows.select("src", F.col("string").alias("string_a"), F.col("key").alias("_x"))
    right = rows.select("src", F.col("string").alias("string_b"), F.col("key").alias("_y"))
    met = pairs.join(left, ["src", "string_a"]).join(right, ["src", "string_b"])
    # A key sent again with another string may meet itself.
    return met.where("_x <> _y").select("src", F.least("_x", "_y").alias("key_a"), F.greatest("_x", "_y").alias("key_b")).distinct()


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strings to compare: claims and page texts."""
    c = table(spark, sf_dir, "claims").select(F.lit("claims").alias("src"), F.col("claim_key").alias("key"), F.col("claim").alias("text"))
    f = table(spark, sf_dir, "fetch_results").select(F.lit("fetch_results").alias("src"), F.col("fetch_id").alias("key"), "text")
    return c.unionByName(f)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alikes(texts(spark, sf_dir))


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of every row in the class of its skeleton."""
    return classes(texts(spark, sf_dir))


QUERIES = {"p7_found": p7_found, "p7_classes": p7_classes}
SQL: dict[str, str] = {}
