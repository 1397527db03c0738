"""Column rules that coerce loosely typed values to a declared type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names whose type is known without a declared schema.
DATE_NAMES = ("signup_date", "order_date")
TIMESTAMP_NAMES = ("created_at",)
TIMESTAMP_SUFFIX = "_at"
INTEGER_SUFFIX = "_id"


def to_integer(value: Column, name: str = "value") -> Column:
    """Whole numbers as BIGINT, text that is no number as NULL; a fraction is an error."""
    whole = value.try_cast("bigint")
    number = F.nullif(value.try_cast("double"), F.lit(float("nan")))
    message = F.concat(F.lit(f"{name}: not a whole number: "), value.cast("string"))
    fraction = number != F.floor(number)
    return F.when(fraction, F.raise_error(message).cast("bigint")).otherwise(
        F.coalesce(F.when(number == whole, whole), number.try_cast("bigint"))
    )


def to_timestamp(value: Column) -> Column:
    """Parsed wall-clock time cut to whole seconds; unparseable as NULL."""
    parsed = F.trim(value.cast("string")).try_cast("timestamp_ntz")
    return F.date_trunc("second", parsed).cast("timestamp_ntz")


def to_date(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("timestamp_ntz").cast("date")


def to_decimal(value: Column, precision: int = 38, scale: int = 2) -> Column:
    """Number rounded to ``scale`` digits, exact for decimals and their text; else NULL."""
    wanted = f"decimal({precision},{scale})"
    number = F.nullif(value.try_cast("double"), F.lit(float("nan")))
    return F.coalesce(value.try_cast(wanted), number.try_cast(wanted))


def to_string(value: Column, max_length: int | None = None) -> Column:
    """Text cut to ``max_length`` characters; untouched when no length is declared."""
    text = value.cast("string")
    return text if max_length is None else F.substring(text, 1, max_length)


def conformed(value: Column, data_type: T.DataType, name: str = "value") -> Column:
    """The rule for a declared type; other types are cast as they are."""
    if isinstance(data_type, T.IntegralType):
        return to_integer(value, name).cast(data_type)
    if isinstance(data_type, T.DateType):
        return to_date(value)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return to_timestamp(value).cast(data_type)
    if isinstance(data_type, T.DecimalType):
        return to_decimal(value, data_type.precision, data_type.scale)
    if isinstance(data_type, (T.VarcharType, T.CharType)):
        return to_string(value, data_type.length)
    if isinstance(data_type, T.StringType):
        return to_string(value)
    return value.cast(data_type)


def by_name(value: Column, name: str) -> Column | None:
    """The rule a column name implies, or None."""
    if name in DATE_NAMES:
        return to_date(value)
    if name in TIMESTAMP_NAMES or name.endswith(TIMESTAMP_SUFFIX):
        return to_timestamp(value)
    if name.endswith(INTEGER_SUFFIX):
        return to_integer(value, name)
    return None


def null_canonical(value: Column, data_type: T.DataType) -> Column:
    """NaN becomes NULL; all other values stay."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value)
    return value
