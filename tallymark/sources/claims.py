"""Claims files: JSON arrays of entries, validated as a whole before anything is read from the web."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Problems listed before the rest is only counted.
MOST_PROBLEMS = 50


class InvalidClaims(ValueError):
    """The file's problems, one per line."""

    def __init__(self, problems: list[str]) -> None:
        super().__init__("\n".join(problems))
        self.problems = problems


def parse_claims(text: DataFrame) -> DataFrame:
    """(label, text of a JSON array) -> one row per entry: label, index, entry (variant), problems.

    A text that is no JSON array gives one row with index null. Other keys stay in ``entry``.
    """
    v = text.select("label", F.try_parse_json("text").alias("v"))
    kind = F.schema_of_variant("v")
    bad = v.where("v is null").select("label", F.lit(None).cast("int").alias("index"), F.lit(None).cast("variant").alias("entry"), F.array(F.concat("label", F.lit(": not valid JSON"))).alias("problems"))
    other = v.where("v is not null").where(~kind.startswith("ARRAY")).select("label", F.lit(None).cast("int").alias("index"), F.col("v").alias("entry"), F.array(F.concat("label", F.lit(": expected a JSON array, got "), json_type(F.col("v")))).alias("problems"))
    rows = v.where("v is not null").where(kind.startswith("ARRAY")).select("label", F.posexplode(F.variant_get("v", "$", "array<variant>")).alias("index", "entry"))
    return rows.withColumn("problems", _problems()).unionByName(other).unionByName(bad)


def json_type(v) -> F.Column:
    s = F.schema_of_variant(v)
    return (
        F.when(F.is_variant_null(v) | (s == "VOID"), "null")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .otherwise("number")
    )


def _problems() -> F.Column:
    at = F.concat(F.col("label"), F.lit("["), F.col("index").cast("string"), F.lit("]"))
    is_object = F.schema_of_variant("entry").startswith("OBJECT")

    def field(name: str) -> F.Column:
        x = F.try_variant_get("entry", f"$.{name}", "variant")
        text = F.try_variant_get("entry", f"$.{name}", "string")
        return (
            F.when(x.isNull(), F.concat(at, F.lit(f": missing {name!r}")))
            .when(json_type(x) != "string", F.concat(at, F.lit(f": {name!r} must be a string, got "), json_type(x)))
            .when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", F.concat(at, F.lit(f": {name!r} is blank")))
        )

    x = F.try_variant_get("entry", "$.id", "variant")
    wrong_id = F.when(x.isNotNull() & ~F.is_variant_null(x) & ~json_type(x).isin("string", "number"), F.concat(at, F.lit(": 'id' must be a string or a number, got "), json_type(x)))
    return F.when(~is_object, F.array(F.concat(at, F.lit(": expected an object, got "), json_type(F.col("entry"))))).otherwise(F.array_compact(F.array(field("claim"), field("source_url"), wrong_id)))


def load_claims(spark: SparkSession, path: str, label: str = "claims") -> DataFrame:
    """(index, id, claim, source_url, entry) of a claims file; raises ``InvalidClaims`` if any entry is wrong.

    Entries keep their place in ``index``; a missing id is ``#<index>``.
    """
    rows = parse_claims(spark.read.text(path, wholetext=True).select(F.lit(label).alias("label"), F.col("value").alias("text")))
    wrong = rows.where(F.size("problems") > 0)
    found = wrong.orderBy(F.col("index").asc_nulls_first()).select(F.explode("problems").alias("p")).limit(MOST_PROBLEMS + 1).collect()
    if found:
        n = wrong.agg(F.sum(F.size("problems"))).first()[0]
        raise InvalidClaims([r.p for r in found[:MOST_PROBLEMS]] + ([f"... and {n - MOST_PROBLEMS} more"] if n > MOST_PROBLEMS else []))
    text = lambda k: F.try_variant_get("entry", f"$.{k}", "string")
    return rows.select("index", F.coalesce(text("id"), F.concat(F.lit("#"), F.col("index").cast("string"))).alias("id"), text("claim").alias("claim"), text("source_url").alias("source_url"), "entry")


def duplicate_ids(claims: DataFrame, key: str = "id", place: str = "index") -> DataFrame:
    """(id, n, first): ids that occur more than once; a warning, no error."""
    return claims.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
