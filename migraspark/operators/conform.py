"""Conforming whole frames to a declared schema, by one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migraspark.functions import conform as rules


def conform(df: DataFrame, spec: T.StructType) -> DataFrame:
    """Coerce the columns named in ``spec``; absent ones are skipped, extra ones untouched."""
    declared = {field.name: field.dataType for field in spec}
    return df.select(
        *[
            rules.conformed(F.col(c), declared[c], c).alias(c) if c in declared else F.col(c)
            for c in df.columns
        ]
    )


def conform_by_name(df: DataFrame) -> DataFrame:
    """Coerce the columns whose names tell their type."""
    columns = []
    for c in df.columns:
        rule = rules.by_name(F.col(c), c)
        columns.append(F.col(c) if rule is None else rule.alias(c))
    return df.select(*columns)


def null_canonical(df: DataFrame) -> DataFrame:
    return df.select(
        *[rules.null_canonical(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]
    )
