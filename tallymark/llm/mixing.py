"""Mixing sources to target shares of tokens, by systematic sampling.

Sizes are tokens of a public tokenizer. A source's documents get the expected number of copies that brings it to its
share of the mix, but no more than its cap; expected copies are summed up in a fixed random order, one random
offset per source is added, and a document is emitted once per integer boundary that its step crosses. So
every document is used its expected copies rounded down or up, and a source misses its expected copies by less than one.

The running sums are made on two levels: per source and slice of the random order, then over the slices,
whose number is bounded; no source is ordered in one task.

Cases: documents without a source (null or blank) and sources without a target are not picked; null and empty texts
have no tokens but take part; a source without documents can't fill its share, whatever its cap; an empty table gives no picks; a null
``max_repeats`` sets no cap; targets sent again count once.

``p9_found`` draws the mix and gives the sources that stay below their tokens in it although none of their documents may be used
again. What the offset leaves out of a source that could give more is no shortfall.
"""

from __future__ import annotations

import base64
import os
from functools import cache

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymark.llm.rows import flat_map
from tallymark.session import cut
from tallymark.sources.tables import table

#: The tokenizer's rank file, and the pattern its vocabulary was made for. The driver sends the file to the executors.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Slices of the random order of a source.
SLICES = 512


@cache
def _encoding(path: str):
    import tiktoken

    sent = SparkFiles.get(os.path.basename(path)) if SparkFiles._root_directory else path
    with open(sent if os.path.exists(sent) else path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: str | None, path: str = TOKENIZER) -> int:
    return len(_encoding(path).encode_ordinary(text)) if text else 0


def token_counts(df: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, text) -> (doc_id, source, n_tokens)."""

    df.sparkSession.sparkContext.addFile(path)

    def count(doc_id, source, text):
        yield doc_id, source, n_tokens(text, path)

    return flat_map(df.select("doc_id", "source", "text"), count, "doc_id bigint, source string, n_tokens bigint")


def with_source(df: DataFrame) -> DataFrame:
    return df.where(F.col("source").isNotNull() & (F.trim("source") != ""))


def plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source with a target: its documents, tokens, wanted tokens, cap and expected copies of each document."""
    of = with_source(counts).groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))
    total = of.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))
    t = targets.where("source is not null").select("source", "target_share", "max_repeats").distinct()
    wanted = F.col("target_share") * F.col("total")
    return (
        t.join(of, "source", "left")
        .crossJoin(F.broadcast(total))  # one row
        .select(
            "source",
            "target_share",
            "max_repeats",
            F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
            F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
            wanted.alias("wanted_tokens"),
        )
        .withColumn("rate", F.when(F.col("n_tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("wanted_tokens") / F.col("n_tokens"))).otherwise(0.0))
    )


def _drawn(counts: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents in the mix, with the source's target."""
    rates = planned.where("rate > 0").select("source", "target_share", "max_repeats", "rate")
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    rows = with_source(counts).withColumn("_at", order).withColumn("_slice", F.pmod(F.shiftright("_at", 40), F.lit(SLICES)))
    sizes = rows.groupBy("source", "_slice").agg(F.count("*").alias("_n"))
    # At most SLICES rows per source.
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy("source").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))).select("source", "_slice", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy("source", "_slice").orderBy("_at", "doc_id"))).join(before, ["source", "_slice"])
    offset = F.pmod(F.xxhash64(F.col("source"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    end = F.col("_before") + F.col("_rank")
    crossed = F.floor(end * F.col("rate") + offset) - F.floor((end - 1) * F.col("rate") + offset)
    return ranked.join(rates, "source").select("doc_id", "source", "n_tokens", crossed.cast("int").alias("copies"), "target_share", "max_repeats").where("copies > 0")


def pick(counts: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents in the mix."""
    return _drawn(counts, plan(counts, targets), seed).select("doc_id", "source", "n_tokens", "copies")


def short_sources(counts: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(source) of the sources whose documents in the mix have too few tokens, with every one of them used ``max_repeats`` times.

    Caps are whole numbers, so a capped source's documents are all drawn that often: its tokens in the mix are tokens x ``max_repeats``.
    """
    planned = plan(counts, targets)
    got = _drawn(counts, planned, seed).groupBy("source", "target_share", F.col("max_repeats").alias("cap")).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("copies"))
    rows = planned.join(got, [planned.source == got.source, planned.target_share == got.target_share, planned.max_repeats.eqNullSafe(got.cap)], "left")
    used_up = (planned.n_tokens == 0) | (F.coalesce("copies", F.lit(0)) >= planned.n_documents * planned.max_repeats)
    return rows.where(used_up & (F.coalesce("mixed_tokens", F.lit(0)) < planned.wanted_tokens)).select(planned.source)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short_sources(cut(_counts(spark, sf_dir)), table(spark, sf_dir, "source_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picked documents with their repeats."""
    return pick(cut(_counts(spark, sf_dir)), table(spark, sf_dir, "source_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that each source was to reach and reaches."""
    counts, targets = cut(_counts(spark, sf_dir)), table(spark, sf_dir, "source_targets")
    got = pick(counts, targets).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    return (
        plan(counts, targets)
        .join(got, "source", "left")
        .crossJoin(F.broadcast(total))  # one row
        .select("source", "target_share", "max_repeats", "n_tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.try_divide(F.coalesce("mixed_tokens", F.lit(0)), F.col("all_tokens")).alias("actual_share"))
    )


QUERIES = {"p9_found": p9_found, "p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
