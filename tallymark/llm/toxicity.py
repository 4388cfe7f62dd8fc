"""Scores for abusive, hateful and sexual language, by a chain of linear classifiers.

A document is as toxic as its worst window of ten words. Words are normalised for look-alikes, accents, figures for
letters and drawn-out letters; a window's features are its words and word pairs, hashed. Raters judge documents,
not windows, and err: each toxic document's window is found by alternating training and choosing,
with out-of-fold predictions, which also lay aside labels that the rest contradicts.

The chain predicts ``sexual``, ``hate``, ``abuse`` and at last ``any``, one logistic model each; every model gets
the earlier ones' probabilities beside the words, in training as out-of-fold predictions. The models are fitted on
the driver over a bounded sample of labelled documents; everything else runs over all documents, whole, in parallel.

Cases: null and empty texts score 0; without labels of both kinds every score is 0; documents that raters disagree on
evenly are not used; repeated labels and rows don't matter beyond their votes; long documents are read whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymark.llm.confusables import skeleton
from tallymark.llm.rows import flat_map
from tallymark.sources.tables import table

#: Labelled documents the models are fitted on, at most, and their words in all; chosen in the order of a hash of their ids.
SAMPLE_DOCUMENTS, SAMPLE_WORDS = 9_000, 8_000_000
#: Windows of clean documents in a fit, at most: those nearest to toxic ones and a hashed rest.
CLEAN_WINDOWS = 20_000
WINDOW, STEP = 10, 2
BITS = 18
SIZE = 1 << BITS
FOLDS = 3
CHAIN = ("sexual", "hate", "abuse", "any")
ROUNDS, STEPS, RATE = 3, 60, 0.3
#: Pull of the weights to zero, in errors of one row; documents that must share a feature,
#: and the share of toxic ones among them, for it to speak for toxicity.
PULL, SUPPORT, SPEAKS = 0.6, 2, 0.4

_FIGURES = str.maketrans("013457@$!|€", "oieastasiie")
_TOKEN = re.compile(r"\S+")
_DRAWN_OUT = re.compile(r"(.)\1+")
_SPACELESS = re.compile(r"[぀-ヿ㐀-鿿ก-๿]")


@lru_cache(maxsize=200_000)
def _token(t: str) -> tuple[int, ...]:
    """Hashes of the words in a piece of text without spaces."""
    s = skeleton(skeleton(t).lower())
    s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
    if _SPACELESS.search(s):
        return tuple(xxhash.xxh32_intdigest(c) for c in s if c.isalnum())
    if s.strip(".,;:!?()[]{}%€$\"'“”„«»").replace(",", "").replace(".", "").isdigit():
        return (xxhash.xxh32_intdigest("#"),)
    out = []
    for part in re.split(r"[/—–…:]|(?<=\w)[\"'“”’](?=\w{3})", s.strip(".,;:!?()[]{}*_\"'“”„«»<>#|-")):
        masked = "*" in part
        w = "".join(c for c in part.translate(_FIGURES) if c.isalpha())
        w = _DRAWN_OUT.sub(r"\1", w)
        if masked:
            w = f"{w[:1]}*"
        if w:
            out.append(xxhash.xxh32_intdigest(w))
    return tuple(out)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(words, pairs): positions in the hashed space; pairs[i] joins words i and i + 1."""
    ids = [h for t in _TOKEN.findall(text) for h in _token(t)]
    h = np.array(ids, dtype=np.uint64)
    words = (h % SIZE).astype(np.int32)
    pairs = ((h[:-1] * np.uint64(2654435761) + h[1:] * np.uint64(40503) + np.uint64(97)) % np.uint64(SIZE)).astype(np.int32) if len(h) > 1 else np.zeros(0, np.int32)
    return words, pairs


@lru_cache(maxsize=4096)
def starts(n: int) -> np.ndarray:
    """Where the windows over n words begin; the last ends with the text."""
    if n <= WINDOW:
        return np.zeros(1 if n else 0, np.int64)
    return np.append(np.arange(0, n - WINDOW, STEP), n - WINDOW)


def window_sums(weights: np.ndarray, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Sum of the weights of each window's words and pairs."""
    at = starts(len(words))
    end = np.minimum(at + WINDOW, len(words))
    a = np.concatenate(([0.0], np.cumsum(weights[words], dtype=np.float64)))
    b = np.concatenate(([0.0], np.cumsum(weights[pairs], dtype=np.float64)))
    return a[end] - a[at] + b[np.maximum(end - 1, at)] - b[at]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class Logistic:
    """Weights of hashed features, of dense features and a bias, fitted by Adam over all rows at once."""

    def __init__(self, n_dense: int) -> None:
        self.w, self.d, self.b = np.zeros(SIZE, np.float32), np.zeros(n_dense), 0.0

    def fit(self, index: np.ndarray, offset: np.ndarray, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, speaks: np.ndarray) -> Logistic:
        used, where = np.unique(index, return_inverse=True)
        w, m, v = (np.zeros(len(used)) for _ in range(3))
        d, dm, dv = (np.zeros(dense.shape[1] + 1) for _ in range(3))
        rows = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(offset))
        where = where.astype(np.int32)
        full = np.hstack((dense, np.ones((len(y), 1))))
        d[-1] = -3.0
        total = weight.sum()
        for t in range(1, STEPS + 1):
            z = np.bincount(rows, w[where], minlength=len(y)) + full @ d
            e = (_sigmoid(z) - y) * weight / total
            g = np.bincount(where, e[rows], minlength=len(used)) + PULL / total * w
            h = full.T @ e
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            dm, dv = 0.9 * dm + 0.1 * h, 0.99 * dv + 0.01 * h * h
            c1, c2 = 1 - 0.9**t, 1 - 0.99**t
            w -= RATE * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            w = np.where(speaks[used], w, np.minimum(w, 0.0))
            d -= RATE * (dm / c1) / (np.sqrt(dv / c2) + 1e-8)
        self.w[used] = w
        self.d, self.b = d[:-1], d[-1]
        return self


class Chain:
    """The fitted models in their order, with the score from which a document counts as toxic."""

    def __init__(self, models: list[Logistic], threshold: float) -> None:
        self.models, self.threshold = models, threshold

    def scores(self, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Probabilities of each window for each category of the chain."""
        n = len(starts(len(words)))
        out = np.zeros((n, len(self.models)))
        for k, m in enumerate(self.models):
            out[:, k] = _sigmoid(window_sums(m.w, words, pairs) + out[:, :k] @ m.d + m.b)
        return out

    def score(self, text: str | None) -> tuple[float, ...]:
        """Probabilities of the worst window: of each category, ``any`` last."""
        words, pairs = features(text) if text else (np.zeros(0, np.int32),) * 2
        if not len(words) or not self.models:
            return (0.0,) * len(CHAIN)
        p = self.scores(words, pairs)
        return tuple(float(x) for x in p[int(np.argmax(p[:, -1]))])


def _stack(docs: list, chosen: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the chosen (document, window)s end to end, and where each begins."""
    parts, offset = [], [0]
    for i, s in chosen:
        words, pairs = docs[i]
        at = starts(len(words))[s]
        part = np.concatenate((words[at : at + WINDOW], pairs[at : at + WINDOW - 1]))
        parts.append(part)
        offset.append(offset[-1] + len(part))
    return np.concatenate(parts), np.array(offset)


def fit_chain(texts: list[str], labels: list[str]) -> Chain:
    """Fits the chain on documents with one label each (``none`` or a category)."""
    return fit_features([features(t) for t in texts], labels)


def fit_features(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[str]) -> Chain:
    """``fit_chain`` for the hashed words and pairs of the documents."""
    keep = [i for i, d in enumerate(docs) if len(d[0])]
    docs, labels = [docs[i] for i in keep], [labels[i] for i in keep]
    toxic = np.array([x != "none" for x in labels], dtype=bool)
    if not toxic.any() or toxic.all():
        return Chain([], 2.0)
    fold = np.array([xxhash.xxh32_intdigest(d[0].tobytes()) % FOLDS for d in docs])
    # To begin with: how much oftener a feature is in toxic documents.
    seen = np.zeros((2, SIZE))
    for d, t in zip(docs, toxic, strict=True):
        seen[int(t), np.unique(np.concatenate(d))] += 1
    odds = np.log((seen[1] + 0.05) / (toxic.sum() + 1)) - np.log((seen[0] + 0.5) / ((~toxic).sum() + 1))
    speaks = (seen[1] >= SUPPORT) & (seen[1] >= SPEAKS * seen.sum(axis=0))
    odds[~speaks] = np.minimum(odds[~speaks], 0.0)
    values = [window_sums(odds, *d) for d in docs]

    clean = [(i, s) for i in np.flatnonzero(~toxic) for s in range(len(values[i]))]
    rank = np.array([values[i][s] for i, s in clean])
    near = np.argsort(-rank, kind="stable")[: CLEAN_WINDOWS // 2]
    rest = np.setdiff1d(np.arange(len(clean)), near)
    order = np.argsort([xxhash.xxh32_intdigest(f"{clean[k][0]}:{clean[k][1]}") for k in rest], kind="stable")[: CLEAN_WINDOWS // 2]
    clean = [clean[k] for k in np.sort(np.concatenate((near, rest[order])))]

    def train(chosen, y, dense, where):
        index, offset = _stack(docs, [chosen[k] for k in where])
        weight = np.where(y[where] > 0, max(1.0, 0.05 * len(where) / max(1, y[where].sum())), 1.0)
        return Logistic(dense.shape[1]).fit(index, offset, dense[where], y[where].astype(float), weight, speaks)

    def out_of_fold(chosen, y, dense):
        p, of = np.zeros(len(chosen)), fold[[i for i, _ in chosen]]
        models = []
        for f in range(FOLDS):
            m = train(chosen, y, dense, np.flatnonzero(of != f))
            index, offset = _stack(docs, [chosen[k] for k in np.flatnonzero(of == f)]) if (of == f).any() else (np.zeros(0, int), np.zeros(1, int))
            if len(offset) > 1:
                p[of == f] = _sigmoid(np.add.reduceat(m.w[index], offset[:-1]) + dense[of == f] @ m.d + m.b)
            models.append(m)
        return p, models

    wrong: set[int] = set()
    best = {i: int(np.argmax(values[i])) for i in np.flatnonzero(toxic)}
    for _ in range(ROUNDS):
        chosen = [(i, s) for i, s in best.items() if i not in wrong] + [c for c in clean if c[0] not in wrong]
        y = np.array([toxic[i] for i, _ in chosen])
        _, models = out_of_fold(chosen, y, np.zeros((len(chosen), 0)))
        worst = np.zeros(len(docs))
        for i, d in enumerate(docs):
            z = window_sums(models[fold[i]].w, *d) + models[fold[i]].b
            worst[i] = _sigmoid(z.max())
            if toxic[i]:
                best[i] = int(np.argmax(z))
        wrong = {int(i) for i in np.flatnonzero(toxic & (worst < 0.35) | ~toxic & (worst > 0.9))}

    chosen = [(i, s) for i, s in best.items() if i not in wrong] + [c for c in clean if c[0] not in wrong]
    dense, final = np.zeros((len(chosen), 0)), []
    everything = np.arange(len(chosen))
    for name in CHAIN:
        y = np.array([toxic[i] and (name == "any" or labels[i] == name) for i, _ in chosen])
        p, folds = out_of_fold(chosen, y, dense)
        final.append((train(chosen, y, dense, everything), folds))
        dense = np.hstack((dense, p[:, None]))
    # The threshold: best F1 of out-of-fold document scores, laid-aside labels left out.
    worst = np.zeros(len(docs))
    for i, d in enumerate(docs):
        worst[i] = Chain([folds[fold[i]] for _, folds in final], 0).scores(*d)[:, -1].max()
    judged = np.array([i not in wrong for i in range(len(docs))])
    grid = np.linspace(0.2, 0.98, 40)
    f1 = [2 * (toxic & judged & (worst >= t)).sum() / max(1, (toxic & judged).sum() + (judged & (worst >= t)).sum()) for t in grid]
    top = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
    return Chain([m for m, _ in final], float(grid[top[len(top) // 2]]))


def judged(labels: DataFrame) -> DataFrame:
    """(doc_id, label): the label most raters give; documents without a majority for or against are left out."""
    votes = labels.where("doc_id is not null and label is not null").groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    return (
        votes.groupBy("doc_id")
        .agg(
            F.sum(F.when(F.col("label") == "none", F.col("n")).otherwise(0)).alias("clean"),
            F.sum(F.when(F.col("label") != "none", F.col("n")).otherwise(0)).alias("toxic"),
            F.max(F.when(F.col("label") != "none", F.struct("n", "label"))).alias("top"),
        )
        .where("clean <> toxic")
        .select("doc_id", F.when(F.col("clean") > F.col("toxic"), "none").otherwise(F.col("top.label")).alias("label"))
    )


_fits: dict[tuple[str, str], Chain] = {}


def _hashed(doc_id: int, text: str, label: str):
    words, pairs = features(text)
    yield doc_id, label, len(words), words.tobytes(), pairs.tobytes()


def fitted(documents: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCUMENTS, most_words: int = SAMPLE_WORDS) -> Chain:
    """The chain fitted on at most ``most`` labelled documents of at most ``most_words`` words; one fit per application and sample.

    Texts stay on the executors: the driver gets their hashed words and pairs, eight bytes for a word.
    """
    # The sample is bounded by ``most`` rows, so it may be broadcast to the documents and ordered in one task.
    order = F.xxhash64("doc_id")
    sample = judged(labels).orderBy(order, "doc_id").limit(most)
    rows = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = flat_map(rows, _hashed, "doc_id bigint, label string, n int, words binary, pairs binary").dropDuplicates(["doc_id"])
    rows = rows.withColumn("upto", F.sum("n").over(W.orderBy(order, "doc_id"))).where(F.col("upto") <= most_words).drop("upto")
    rows = sorted(rows.collect(), key=lambda r: r.doc_id)
    key = (documents.sparkSession.sparkContext.applicationId, hashlib.sha256(repr([(r.doc_id, r.label) for r in rows]).encode() + b"".join(r.words for r in rows)).hexdigest())
    if key not in _fits:
        _fits[key] = fit_features([(np.frombuffer(r.words, np.int32), np.frombuffer(r.pairs, np.int32)) for r in rows], [r.label for r in rows])
    return _fits[key]


def scored(documents: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, source, text) -> (doc_id, source, sexual, hate, abuse, score, toxic)."""
    sent = documents.sparkSession.sparkContext.broadcast(chain)  # four vectors of fixed size

    def score(c: Chain, doc_id, source, text):
        *kinds, p = c.score(text)
        yield (doc_id, source, *kinds, p, p >= c.threshold)

    return flat_map(documents.select("doc_id", "source", "text"), score, "doc_id bigint, source string, sexual double, hate double, abuse double, score double, toxic boolean", setup=lambda: (sent.value,))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return scored(d, fitted(d, table(spark, sf_dir, "doc_labels")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("toxic").select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores."""
    return _scored(spark, sf_dir)


def p10_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents per source; documents without one under null."""
    s = _scored(spark, sf_dir).select("source", F.col("toxic").cast("int").alias("toxic"))
    return s.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("toxic").alias("n_toxic")).withColumn("rate", F.col("n_toxic") / F.col("n_documents"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_source_rates": p10_source_rates}
SQL: dict[str, str] = {}
