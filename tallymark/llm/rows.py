"""Running Python over rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def flat_map(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str | StructType, setup: Callable[[], tuple] | None = None, batch: int = 2000) -> DataFrame:
    """``fn(*row)`` yields the tuples that stand for a row; ``setup`` makes its first arguments once per task.

    Rows stream through: no more than one incoming batch and ``batch`` results are held at a time.
    """
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = to_arrow_schema(kind)
        first = setup() if setup else ()
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(fields)
            r = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)
            out.clear()
            return r

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.extend(fn(*first, *row))
                if len(out) >= batch:
                    yield made()
        yield made()

    return df.mapInArrow(run, kind)


def host(url: Column) -> Column:
    """Lower-case host of a web address without port, user and leading ``www.``; null if there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(h, r"^www\.|\.$", ""), F.lit(""))


def first_of_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key of rows that may have been sent again."""
    return df.dropDuplicates([key])
