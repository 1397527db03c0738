"""Column rules that make two result sets comparable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A column is a measure when its name contains one of these.
MEASURE_HINTS = (
    "revenue",
    "spend",
    "amount",
    "count",
    "orders",
    "customers",
    "pct",
    "rate",
    "avg",
    "average",
    "rank",
    "percentile",
    "delta",
    "converted",
    "repeat",
    "buyers",
    "quality",
    "tenure",
)

# A text column is tried as a date when its name contains one of these.
DATE_TOKENS = ("date", "month", "cohort", "timestamp", "time")

# Texts that stand for a missing value, in normalising and in comparing.
MISSING_EXACT = ("<NA>", "nan", "None")
MISSING_ANY_CASE = ("", "nan", "none", "<na>")

RTOL = 1e-4
ATOL = 1e-4

TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss"
INFINITY = float("inf")


def is_measure(name: str) -> bool:
    return any(hint in name.lower() for hint in MEASURE_HINTS)


def measure_flag(name: Column) -> Column:
    """``is_measure`` over a column of names."""
    return F.exists(
        F.array(*[F.lit(hint) for hint in MEASURE_HINTS]),
        lambda hint: F.contains(F.lower(name), hint),
    )


def looks_like_date(name: str) -> bool:
    return any(token in name.lower() for token in DATE_TOKENS)


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def is_temporal(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric(column: Column, data_type: T.DataType) -> Column:
    """Whole numbers and booleans as BIGINT, other numbers as DOUBLE with NaN as NULL."""
    if isinstance(data_type, (T.IntegralType, T.BooleanType)):
        return column.cast("bigint")
    return F.nullif(column.cast("double"), F.lit(float("nan")))


def parsed_timestamp(text: Column) -> Column:
    return F.trim(text).try_cast("timestamp_ntz")


def temporal_text(column: Column) -> Column:
    return F.coalesce(F.date_format(column, TIMESTAMP_TEXT), F.lit(""))


def plain_text(column: Column) -> Column:
    trimmed = F.trim(column)
    return F.when(trimmed.isNull() | trimmed.isin(*MISSING_EXACT), "").otherwise(trimmed)


def canonical_text(column: Column) -> Column:
    trimmed = F.trim(column.cast("string"))
    missing = trimmed.isNull() | F.lower(trimmed).isin(*MISSING_ANY_CASE)
    return F.when(missing, "").otherwise(trimmed)


def to_number(column: Column, data_type: T.DataType) -> Column:
    """The numeric reading of any normalised column; text that is no number gives NULL."""
    if isinstance(data_type, T.StringType):
        return F.nullif(column.try_cast("double"), F.lit(float("nan")))
    return column.cast("double")


def numbers_match(x: Column, y: Column, rtol: float, atol: float) -> Column:
    """Equal, or within tolerance of a finite target, or both missing. Tolerance scales with y."""
    finite = F.abs(y) < F.lit(INFINITY)
    close = finite & (F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y))
    return F.coalesce((x == y) | close, F.lit(False)) | (x.isNull() & y.isNull())


def texts_match(x: Column, y: Column) -> Column:
    return canonical_text(x) == canonical_text(y)


# ---------------------------------------------------------------- nested values

LEAVES = "array<struct<path: string, number: double, text: string>>"


def is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StructType, T.ArrayType, T.MapType, T.VariantType))


def leaves(column: Column, data_type: T.DataType, path: Column | None = None) -> Column:
    """The single values inside a nested one, each with its path: fields by name, elements by place,
    map entries in the order of their keys. A missing value has one leaf without text or number, an
    empty list or map none.

    A VARIANT is one leaf, its JSON text with sorted fields.
    """
    path = F.lit("") if path is None else path
    if isinstance(data_type, T.StructType):
        parts = [
            leaves(column[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in data_type.fields
        ]
        found = F.concat(*parts) if parts else F.array().cast(LEAVES)
    elif isinstance(data_type, T.ArrayType):
        found = F.flatten(
            F.transform(
                column,
                lambda x, i: leaves(x, data_type.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))),
            )
        )
    elif isinstance(data_type, T.MapType):
        found = F.flatten(
            F.transform(
                F.array_sort(F.map_keys(column)),
                lambda k: leaves(
                    F.element_at(column, k), data_type.valueType, F.concat(path, F.lit("."), k.cast("string"))
                ),
            )
        )
    else:
        number = text = F.lit(None)
        if is_numeric(data_type):
            number = numeric(column, data_type)
        elif isinstance(data_type, T.VariantType):
            text = F.to_json(column)
        elif is_temporal(data_type):
            text = temporal_text(column)
        else:
            text = plain_text(column.cast("string"))
        return F.array(
            F.struct(path.alias("path"), number.cast("double").alias("number"), text.cast("string").alias("text"))
        )
    missing = F.array(
        F.struct(path.alias("path"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("text"))
    )
    return F.when(column.isNull(), missing).otherwise(found).cast(LEAVES)


def leaf_mismatches(x: Column, y: Column, rtol: float, atol: float) -> Column:
    """The leaves of two nested values that differ, or stand on one side only: (path, x, y, gap)."""

    def shown(leaf: Column) -> Column:
        return F.coalesce(leaf["number"].cast("string"), leaf["text"])

    def differs(pair: Column) -> Column:
        a, b = pair["x"], pair["y"]
        same = a["path"].eqNullSafe(b["path"])
        numbers = a["number"].isNotNull() | b["number"].isNotNull()
        equal = F.when(numbers, numbers_match(a["number"], b["number"], rtol, atol)).otherwise(
            texts_match(a["text"], b["text"])
        )
        return ~(same & equal)

    pairs = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), differs)
    return F.transform(
        pairs,
        lambda p: F.struct(
            F.coalesce(p["x"]["path"], p["y"]["path"]).alias("path"),
            shown(p["x"]).alias("x"),
            shown(p["y"]).alias("y"),
            F.when(p["x"]["path"].eqNullSafe(p["y"]["path"]), F.abs(p["x"]["number"] - p["y"]["number"])).alias("gap"),
        ),
    )
