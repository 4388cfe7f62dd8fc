"""Held-out test passages inside a corpus, found by pigeonhole edit matching over words.

What counts is half of an item, as one passage or two neighbouring ones, with up to one word in eight replaced: of P words
that hold e errors and one gap at most, some piece of (P - e) / (e + 2) words is exact, rounded up. So an item's pieces are its runs of
that many words, at every offset, as a passage may start anywhere; an item of fewer than eight words must appear whole, but for
one word from four on. One Aho-Corasick automaton finds all pieces in a normalised document in one pass; hits on one
diagonal make a passage, which is extended and then verified by Myers' bit-parallel edit distance over words; of a passage that
fails, as it goes over a rewritten stretch, every part between two of its exact runs is verified by itself. An item leaks if
one passage, or two neighbouring ones in order, hold half of its words.

Items go to the executors in blocks of bounded size, each against all documents; documents are never shuffled. A process
makes a block's automaton once.

Cases: null and empty texts hold nothing; long documents are read whole; repeated passages and repeated rows give one
result per document and item; case, punctuation, line breaks, markup and look-alike characters don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import pairwise

import ahocorasick
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.confusables import skeleton
from tallymark.llm.rows import flat_map
from tallymark.sources.tables import table

#: One error in so many words; share of an item's words that makes a leak; items of fewer words must appear whole.
ONE_ERROR_IN, SHARE, SHORT = 8, 0.5, 8
#: Words of other text between two neighbouring passages, at most.
NEIGHBOUR_WORDS = 120
#: Characters of items in a block that is sent to the executors.
BLOCK_CHARS = 8_000_000

_TAG = re.compile(r"<[^<>\n]{1,200}>|\]\([^()\s]{1,400}\)")
_HYPHEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\n[ \t>]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Normalised words, without markup and in one character form."""
    s = skeleton(text)
    s = skeleton(s.lower()) if not s.isascii() else s.lower()
    if "<" in s or "](" in s:
        s = _TAG.sub(" ", s)
    if "-" in s:
        s = _HYPHEN.sub("", s)
    return _WORD.findall(s)


def myers(pattern: list[str], text: list[str]) -> int:
    """Edit distance of two word lists, by Myers' bit-parallel columns (global)."""
    m = len(pattern)
    if not m:
        return len(text)
    eq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for w in text:
        x = eq.get(w, 0)
        xv = x | mv
        xh = (((x & pv) + pv) ^ pv) | x
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 | 1
        mh <<= 1
        pv = full & (mh | ~(xv | ph))
        mv = full & ph & xv
    return score


def budget(n: int) -> int:
    """Words that may be replaced in a passage of n words."""
    return -(-n // ONE_ERROR_IN) if n >= SHORT // 2 else 0


def piece_words(n: int) -> int:
    """Words of the exact piece that any leak of an item of n words must hold."""
    gap, least = (0, n) if n < SHORT else (1, -(-n // 2))
    e = budget(least)
    return -(-(least - e) // (e + 1 + gap))


class Matcher:
    """The automaton over all pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = {k: words(t) for k, t in items if t}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, w in self.items.items():
            q = piece_words(len(w))
            for i in range(len(w) - q + 1 if w else 0):
                pieces.setdefault(" " + " ".join(w[i : i + q]) + " ", []).append((k, i))
        self.automaton = ahocorasick.Automaton()
        for p, at in pieces.items():
            self.automaton.add_word(p, (len(p), at))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def leaks(self, text: str) -> list[tuple[int, float]]:
        """(item, share of its words held) of the items that leak into a text."""
        w = words(text)
        if self.empty or not w:
            return []
        line = " " + " ".join(w) + " "
        hits: dict[int, list[tuple[int, int]]] = {}
        starts: list[int] = []
        for end, (n, at) in self.automaton.iter(line):
            if not starts:
                n_at = 0
                for x in w:
                    starts.append(n_at)
                    n_at += len(x) + 1
            d = bisect_right(starts, end - n + 1) - 1
            for k, p in at:
                hits.setdefault(k, []).append((d, p))
        out = []
        for k, h in hits.items():
            share = self._share(self.items[k], w, h)
            if share >= SHARE:
                out.append((k, share))
        return out

    def _share(self, item: list[str], doc: list[str], hits: list[tuple[int, int]]) -> float:
        n = len(item)
        if n < SHORT:  # whole, on a hit's diagonal
            starts = {d - p for d, p in hits if d >= p}
            return 1.0 if any(myers(item, doc[d : d + n]) <= budget(n) for d in starts) else 0.0
        passages = sorted({tuple(s) for c in self._chains(hits, piece_words(n)) for s in self._passages(item, doc, c)})
        half, best = -(-n // 2), 0
        for i, a in enumerate(passages):
            best = max(best, self._held(item, doc, half, a))
            if best == n:
                break
            for b in passages[i + 1 :]:
                if b[0] - a[1] > NEIGHBOUR_WORDS:
                    break
                if a[1] <= b[0] + 2 and b[2] >= a[3] - 2:
                    best = max(best, self._held(item, doc, half, a, b))
        return best / n

    @staticmethod
    def _chains(hits: list[tuple[int, int]], q: int) -> list[list[list[int]]]:
        """Hits on nearly one diagonal as chains of runs (document start, end, item start, end) that are alike word for word."""
        reach = 2 * ONE_ERROR_IN
        done: list[list[list[int]]] = []
        active: list[list[list[int]]] = []
        for d, p in sorted(set(hits)):
            active = [c for c in active if d - c[-1][1] <= reach]
            for c in reversed(active):
                s = c[-1]
                if p >= c[0][2] and abs((d - p) - (s[1] - s[3])) <= 2 and p - s[3] <= reach and d + q > s[1] and p + q > s[3]:
                    if d - p == s[1] - s[3] and d <= s[1]:
                        s[1], s[3] = d + q, p + q
                    else:
                        c.append([d, d + q, p, p + q])
                    break
            else:
                active.append([[d, d + q, p, p + q]])
                done.append(active[-1])
        return done

    def _passages(self, item: list[str], doc: list[str], chain: list[list[int]]) -> list[list[int]]:
        """The whole chain if it is verified, else every part of it that is."""
        whole = self._passage(item, doc, chain[0], chain[-1])
        if whole or len(chain) == 1:
            return [whole] if whole else []
        parts = ((i, j) for i in range(len(chain)) for j in range(i, len(chain)))
        return [s for i, j in parts if (s := self._passage(item, doc, chain[i], chain[j]))]

    def _passage(self, item: list[str], doc: list[str], first: list[int], last: list[int]) -> list[int] | None:
        plain = [first[0], last[1], first[2], last[3]]
        for s in (self._extended(item, doc, plain, 1), self._extended(item, doc, plain, 2), plain):
            if self._verified(item, doc, s):
                return s
        return None

    @staticmethod
    def _extended(item: list[str], doc: list[str], s: list[int], beyond: int) -> list[int]:
        """The passage with the words beside it that are equal, and over a replaced one where ``beyond`` words behind that are."""
        d0, d1, i0, i1 = s
        while i1 < len(item) and d1 < len(doc):
            if item[i1] == doc[d1]:
                step = 1
            elif min(len(item) - i1, len(doc) - d1) > 1 and item[i1 + 1 : i1 + 1 + beyond] == doc[d1 + 1 : d1 + 1 + beyond]:
                step = 2
            else:
                break
            i1, d1 = i1 + step, d1 + step
        while i0 and d0:
            if item[i0 - 1] == doc[d0 - 1]:
                step = 1
            elif min(i0, d0) > 1 and item[max(0, i0 - 1 - beyond) : i0 - 1] == doc[max(0, d0 - 1 - beyond) : d0 - 1]:
                step = 2
            else:
                break
            i0, d0 = i0 - step, d0 - step
        return [d0, d1, i0, i1]

    @staticmethod
    def _held(item: list[str], doc: list[str], half: int, *parts: tuple[int, ...]) -> int:
        """Words of the item that one or two passages hold.

        A replaced word at a passage's end is one of it: where half of the item is missed by no more than that, what the passages
        leave of their budget is added as far as both texts have room.
        """
        n = sum(s[3] - s[2] for s in parts) - sum(max(0, a[3] - b[2]) for a, b in pairwise(parts))
        if not half - budget(half) <= n < half:
            return n
        left = budget(half) - sum(myers(item[s[2] : s[3]], doc[s[0] : s[1]]) for s in parts)
        room = sum(min(s[0], s[2]) + min(len(doc) - s[1], len(item) - s[3]) for s in parts)
        return n + max(0, min(left, room))

    @staticmethod
    def _verified(item: list[str], doc: list[str], s: list[int]) -> bool:
        return myers(item[s[2] : s[3]], doc[s[0] : s[1]]) <= budget(s[3] - s[2])


def leaks(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, text) and (item_id, text) -> (doc_id, item_id, share) of the items that documents hold."""
    spark = documents.sparkSession
    items = items.where("item_id is not null and text is not null").select("item_id", "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    parts = []
    for b in range(blocks):
        block = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        sent = spark.sparkContext.broadcast(block)
        parts.append(flat_map(docs, _leaks, "doc_id bigint, item_id bigint, share double", setup=lambda sent=sent: (_matcher(sent),)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


_made: dict[int, Matcher] = {}


def _matcher(block: Broadcast) -> Matcher:
    """The block's automaton; a process keeps the one it made last."""
    key = hash(tuple(block.value))
    if key not in _made:
        _made.clear()
        _made[key] = Matcher(block.value)
    return _made[key]


def _leaks(matcher: Matcher, key: int, text: str):
    for item, share in matcher.leaks(text):
        yield key, item, share


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the number of documents that hold it."""
    n = _all(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return table(spark, sf_dir, "eval_items", "item_id", "suite").join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


QUERIES = {"p8_found": p8_found, "p8_leaked_items": p8_leaked_items}
SQL: dict[str, str] = {}
