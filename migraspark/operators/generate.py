"""Seeded synthetic tables from declared schemas: one projection over row ids."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migraspark.functions import values as V
from migraspark.functions.draws import Draw

# Rows of the three base tables, rows where none are given, and the seed.
DEFAULT_ROWS = {"customers": 3000, "orders": 12000, "products": 100}
ROWS_WHEN_UNSPECIFIED = 1000
DEFAULT_SEED = 42

ROW_ID = "row_id"


@dataclass(frozen=True)
class ColumnGen:
    """How one column departs from what its name and type imply.

    ``provider`` wins over ``kind`` (``numeric``, ``decimal``, ``date``, ``text`` or ``key``, the row
    id itself), and both win over the name. ``null_rate`` holds even for a NOT NULL column. A column
    that ``references`` a table gets keys of rows that table has, where both are generated together.
    """

    provider: str | None = None
    kind: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    start_date: str = V.DATE_RANGE[0]
    end_date: str = V.DATE_RANGE[1]
    null_rate: float | None = None
    length_range: tuple[int, int] = V.SIZE_RANGE
    size_range: tuple[int, int] = V.SIZE_RANGE
    references: str | None = None


def read_overrides(spark: SparkSession, path: str) -> dict[str, ColumnGen]:
    """Overrides by column from a JSON file ``{"column_mappings": {column: {field: value}}}``.

    Fields are those of ``ColumnGen``; ranges are lists of two. Other fields raise a TypeError.
    """
    text = spark.read.text(path, wholetext=True).first()
    given = json.loads(text["value"]).get("column_mappings", {}) if text else {}
    return {
        column: ColumnGen(**{k: tuple(v) if isinstance(v, list) else v for k, v in fields.items()})
        for column, fields in given.items()
    }


@dataclass(frozen=True)
class TableSpec:
    """A table's name, its field list such as ``id INT NOT NULL, tags ARRAY<STRING>``, and the
    columns' overrides."""

    name: str
    fields: str
    mappings: Mapping[str, ColumnGen] = field(default_factory=dict)

    @classmethod
    def from_ddl_fields(
        cls, name: str, fields: str, mappings: Mapping[str, ColumnGen] | None = None
    ) -> TableSpec:
        return cls(name, fields, mappings or {})

    @property
    def schema(self) -> T.StructType:
        """The declared columns; Spark reads the field list, so a session must be running."""
        return T.StructType.fromDDL(self.fields)

    def null_rate(self, column: T.StructField) -> float:
        given = self.mappings.get(column.name, ColumnGen()).null_rate
        if given is not None:
            return given
        return V.NULL_RATE if column.nullable else 0.0


def orders_spec(customers: int) -> TableSpec:
    """Orders whose customers are numbered from 1 to ``customers``."""
    return TableSpec.from_ddl_fields(
        "orders",
        "order_id INT NOT NULL, customer_id INT, order_date DATE, amount DECIMAL(10,2), "
        "company VARCHAR(100), status VARCHAR(20)",
        {
            "order_id": ColumnGen(kind="key"),
            "customer_id": ColumnGen(
                kind="numeric", minimum=1, maximum=customers + 1, references="customers"
            ),
        },
    )


# The base schemas are fixed values; the key columns and their ranges are this library's own.
BASE_SPECS = {
    "customers": TableSpec.from_ddl_fields(
        "customers",
        "customer_id INT NOT NULL, first_name VARCHAR(50), last_name VARCHAR(50), "
        "email VARCHAR(100), phone VARCHAR(30), address VARCHAR(255), city VARCHAR(50), "
        "country VARCHAR(50), signup_date DATE, created_at TIMESTAMP_NTZ",
        {"customer_id": ColumnGen(kind="key"), "address": ColumnGen(null_rate=0.02)},
    ),
    "orders": orders_spec(DEFAULT_ROWS["customers"]),
    "products": TableSpec.from_ddl_fields(
        "products",
        "product_id INT NOT NULL, product_name VARCHAR(100), product_url VARCHAR(255), "
        "price DECIMAL(10,2)",
        {"product_id": ColumnGen(kind="key"), "product_name": ColumnGen(provider="words")},
    ),
}

NESTED_SPEC = TableSpec.from_ddl_fields(
    "ecommerce_orders",
    "order_id INT NOT NULL, customer_id INT NOT NULL, order_date DATE NOT NULL, "
    "status STRING NOT NULL, "
    "customer STRUCT<name: STRING, email: STRING, phone: STRING, loyalty_tier: STRING> NOT NULL, "
    "shipping_address STRUCT<street: STRING, city: STRING, state: STRING, zip_code: STRING, "
    "country: STRING> NOT NULL, "
    "order_items ARRAY<STRUCT<product_id: INT, product_name: STRING, quantity: INT, "
    "unit_price: DECIMAL(10,2)>> NOT NULL, "
    "payments ARRAY<STRUCT<payment_id: STRING, method: STRING, amount: DECIMAL(10,2), "
    "status: STRING>>, "
    "tags ARRAY<STRING>, metadata MAP<STRING,STRING>, price_breakdown MAP<STRING,DECIMAL(10,2)>",
    {
        "tags": ColumnGen(length_range=(2, 5), null_rate=0.05),
        "scores": ColumnGen(length_range=(3, 10), null_rate=0.01),
        "metadata": ColumnGen(size_range=(2, 4), null_rate=0.05),
        "config": ColumnGen(size_range=(1, 3), null_rate=0.0),
        "contacts": ColumnGen(length_range=(1, 5), null_rate=0.10),
        "settings": ColumnGen(size_range=(2, 4), null_rate=0.05),
    },
)


# ---------------------------------------------------------------- values by type


def scalar(draw: Draw, data_type: T.DataType, nested: bool) -> Column:
    """A value of a plain type; decimals are normal at top level and uniform inside others."""
    if isinstance(data_type, T.IntegralType):
        return V.integer(draw).cast(data_type)
    if isinstance(data_type, (T.DecimalType, T.FractionalType)):
        value = V.decimal_uniform(draw) if nested else V.decimal_normal(draw)
        return value.cast(data_type)
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return V.timestamp(draw).cast(data_type)
    if isinstance(data_type, T.BooleanType):
        return V.coin(draw)
    return V.word(draw)


def nested_value(draw: Draw, name: str, data_type: T.DataType, gen: ColumnGen) -> Column:
    """A value inside a struct, array or map: by field name where that is known, else by type."""
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
        return complex_value(draw, data_type, gen)
    provider = V.hinted_provider(name)
    if provider and isinstance(data_type, T.StringType):
        return V.PROVIDERS[provider](draw)
    return scalar(draw, data_type, nested=True)


def struct_value(draw: Draw, data_type: T.StructType, gen: ColumnGen) -> Column:
    return F.struct(
        *[
            nested_value(draw.child(f.name), f.name, f.dataType, gen).alias(f.name)
            for f in data_type
        ]
    )


def _slots(draw: Draw, bounds: tuple[int, int], salt: str) -> Column:
    """1..size with a size drawn from the inclusive bounds; empty for size 0."""
    low, high = bounds
    size = draw.integer(low, high + 1, salt).cast("int")
    empty = F.array().cast("array<int>")
    return F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(empty)


def array_value(draw: Draw, data_type: T.ArrayType, gen: ColumnGen) -> Column:
    element = data_type.elementType
    return F.transform(
        _slots(draw, gen.length_range, "length"),
        lambda slot: nested_value(draw.at(slot), "element", element, gen),
    )


def map_value(draw: Draw, data_type: T.MapType, gen: ColumnGen) -> Column:
    """String keys; a key drawn twice keeps its last value."""
    entries = F.transform(
        _slots(draw, gen.size_range, "size"),
        lambda slot: F.struct(
            nested_value(draw.child("key").at(slot), "key", data_type.keyType, gen)
            .cast("string")
            .alias("key"),
            nested_value(draw.child("value").at(slot), "value", data_type.valueType, gen).alias(
                "value"
            ),
        ),
    )
    # A one-element array around the entries gives them a name, so they are drawn once.
    return F.transform(F.array(entries), _last_of_each_key)[0]


def _last_of_each_key(entries: Column) -> Column:
    kept = F.filter(
        entries,
        lambda entry, place: ~F.exists(
            F.slice(entries, place + 2, F.size(entries)), lambda later: later["key"] == entry["key"]
        ),
    )
    return F.map_from_entries(kept)


def complex_value(draw: Draw, data_type: T.DataType, gen: ColumnGen) -> Column:
    if isinstance(data_type, T.StructType):
        return struct_value(draw, data_type, gen)
    if isinstance(data_type, T.ArrayType):
        return array_value(draw, data_type, gen)
    return map_value(draw, data_type, gen)


def _fit(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, (T.VarcharType, T.CharType)):
        return F.substring(value, 1, data_type.length)
    if isinstance(data_type, T.StringType):
        return value.cast("string")
    return value.cast(data_type)


def column_value(draw: Draw, column: T.StructField, gen: ColumnGen) -> Column:
    """Provider, then kind, then name, then type."""
    data_type = column.dataType
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
        return complex_value(draw, data_type, gen)
    if gen.provider is not None:
        if gen.provider not in V.PROVIDERS:
            raise ValueError(f"{column.name}: unknown provider {gen.provider!r}")
        return _fit(V.PROVIDERS[gen.provider](draw), data_type)
    if gen.kind is not None:
        return _fit(_by_kind(draw, gen), data_type)
    provider = V.hinted_provider(column.name)
    if provider is not None and isinstance(
        data_type, (T.StringType, T.VarcharType, T.CharType)
    ):
        return _fit(V.PROVIDERS[provider](draw), data_type)
    return _fit(scalar(draw, data_type, nested=False), data_type)


def _by_kind(draw: Draw, gen: ColumnGen) -> Column:
    if gen.kind == "key":
        return draw.row
    if gen.kind == "numeric":
        low, high = V.INTEGER_RANGE
        low = low if gen.minimum is None else int(gen.minimum)
        high = high if gen.maximum is None else int(gen.maximum)
        return V.integer(draw, low, high)
    if gen.kind == "decimal":
        low, high = V.NESTED_DECIMAL_RANGE
        low = low if gen.minimum is None else gen.minimum
        high = high if gen.maximum is None else gen.maximum
        return V.decimal_uniform(draw, low, high)
    if gen.kind == "date":
        return V.timestamp(draw, gen.start_date, gen.end_date)
    if gen.kind == "text":
        return V.word(draw)
    raise ValueError(f"unknown kind {gen.kind!r}")


# ---------------------------------------------------------------- tables


def row_spine(spark: SparkSession, rows: int, partitions: int | None = None) -> DataFrame:
    """Row ids 1..rows."""
    return spark.range(1, rows + 1, 1, partitions).withColumnRenamed("id", ROW_ID)


def generate(
    spec: TableSpec,
    spine: DataFrame,
    seed: int = DEFAULT_SEED,
    as_json: bool = True,
    portable: bool = False,
) -> DataFrame:
    """All columns of ``spec`` for the row ids in ``spine``, without a shuffle.

    Nested columns become JSON text, or stay nested with ``as_json=False``. ``portable`` draws by
    md5, which other engines can repeat, at several times the cost.
    """
    columns = []
    for column in spec.schema:
        draw = Draw(seed, spec.name, column.name, F.col(ROW_ID), fast=not portable)
        value = column_value(draw, column, spec.mappings.get(column.name, ColumnGen()))
        if as_json and isinstance(column.dataType, (T.StructType, T.ArrayType, T.MapType)):
            value = F.to_json(value)
        rate = spec.null_rate(column)
        if rate > 0:
            value = F.when(~draw.chance(rate, "null"), value)
        columns.append(value.alias(column.name))
    return spine.select(*columns)


def _with_known_keys(spec: TableSpec, counts: Mapping[str, int]) -> TableSpec:
    """``spec`` with its references pointing at rows 1 to n of the tables in ``counts``."""
    known = {
        column: replace(gen, kind="numeric", minimum=1, maximum=counts[gen.references] + 1)
        for column, gen in spec.mappings.items()
        if gen.references in counts
    }
    return replace(spec, mappings={**spec.mappings, **known}) if known else spec


def generate_tables(
    spark: SparkSession,
    specs: Sequence[TableSpec],
    base: str,
    rows: Mapping[str, int] | None = None,
    seed: int = DEFAULT_SEED,
    as_json: bool = True,
    parallel: int = 4,
    record: Callable[[DataFrame, Sequence[str]], None] | None = None,
) -> DataFrame:
    """Write every table below ``base``; one log row per table, in the order of ``specs``, failures
    included. ``parallel`` tables are written at a time.

    A reference to a table of ``specs`` names only rows which that table gets here.
    ``record`` is called once with the log and its order: ``HistoryStore.log_generation`` appends it.
    """
    wanted = rows or DEFAULT_ROWS
    counts = {spec.name: wanted.get(spec.name, ROWS_WHEN_UNSPECIFIED) for spec in specs}

    def one(spec: TableSpec) -> tuple:
        path, count = f"{base}/{spec.name}", counts[spec.name]
        try:
            table = generate(_with_known_keys(spec, counts), row_spine(spark, count), seed, as_json)
            table.write.mode("overwrite").parquet(path)
            return (spec.name, path, count, len(spec.schema), seed, True, None)
        except Exception as error:  # one bad table must not stop the others
            return (spec.name, None, None, None, seed, False, str(error))

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        log = list(pool.map(inheritable_thread_target(spark)(one), specs))
    logged = spark.createDataFrame(
        log,
        "table_name string, output_file_path string, row_count bigint, column_count int, "
        "seed int, success boolean, error_message string",
    )
    if record is not None:
        record(logged, ["table_name"])
    return logged


def table_profile(df: DataFrame, name: str, order: Sequence[str], shown: int = 3) -> DataFrame:
    """Name, rows, columns and the first ``shown`` rows as JSON."""
    first = df.orderBy(*order).limit(shown)
    rows = F.array_sort(F.collect_list(F.struct(*order, F.to_json(F.struct("*")).alias("__json"))))
    sample = first.agg(F.transform(rows, lambda r: r["__json"]).alias("first_rows"))
    size = df.select(F.count("*")).scalar()
    return sample.select(
        F.lit(name).alias("table_name"),
        size.alias("rows"),
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(", ".join(df.columns)).alias("columns"),
        F.to_json("first_rows").alias("first_rows"),
    )
