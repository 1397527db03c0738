"""Sources and sinks: what is written to the shared folder is read back and checked."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from migraspark.catalog import query
from migraspark.catalog.reconcile import RUNS_SQL, SIDES_SQL, _pairs, orders, repriced
from migraspark.operators import reconcile as R
from migraspark.plans import bindings as B
from migraspark.session import scratch_path
from migraspark.sources import results as IO
from migraspark.sources.corpus import read_corpus
from migraspark.sources.tables import run_side, scan, views

CSV_SCHEMA = "doc_id BIGINT, lang STRING, text STRING, n_chars BIGINT"


@query("src_01_read_result_csv", "SELECT doc_id, lang, text, n_chars FROM documents")
def src_01(spark, folder):
    base = scratch_path(spark, "csv")
    texts = scan(spark, folder, "documents").select("doc_id", "lang", "text", "n_chars")
    # The texts have line breaks, so each file is read by one task: many files of some rows.
    IO.export(texts, 1, "source", base, file_format="csv", rows_per_file=2000)
    return IO.read_result(spark, IO.export_path(base, 1, "source"), CSV_SCHEMA, multiline=True)


@query(
    "src_02_read_sql_corpus",
    r"""SELECT regexp_replace(text, '^\s+|\s+\z', '', 'g') AS text FROM benchmark
WHERE regexp_replace(text, '^\s+|\s+\z', '', 'g') <> ''""",
)
def src_02(spark, folder):
    base = scratch_path(spark, "corpus")
    texts = scan(spark, folder, "benchmark").select("item_id", F.concat("text", F.lit("\n ")))
    texts.write.partitionBy("item_id").text(base)
    return read_corpus(spark, base, nested=True).select("text")


@query(
    "src_03_scan_base_tables",
    f"""{B.BASE_SQL} SELECT country, COUNT(*) AS orders, CAST(SUM(amount) AS DOUBLE) AS revenue,
  (SELECT COUNT(*) FROM prod) AS products FROM cust JOIN ord USING (customer_id) GROUP BY country""",
)
def src_03(spark, folder):
    views(spark, B.base_tables(spark, folder)._asdict(), namespace="legacy")
    return spark.sql(
        """WITH spend AS (SELECT customer_id, COUNT(*) AS orders, SUM(amount) AS amount
             FROM legacy__orders GROUP BY customer_id)
           SELECT country, SUM(orders) AS orders, CAST(SUM(amount) AS DOUBLE) AS revenue,
             (SELECT COUNT(*) FROM legacy__products) AS products
           FROM legacy__customers JOIN spend USING (customer_id) GROUP BY country"""
    )


SIDE_TEXT = """-- orders of one status
   -- runs on either side
SELECT status, COUNT(*) AS orders, CAST(SUM(amount) AS DOUBLE) AS revenue
FROM {orders}
GROUP BY status;
"""


@query(
    "src_04_run_side_query",
    f"""{SIDES_SQL} SELECT 'source' AS side, status, COUNT(*) AS orders,
  CAST(SUM(CAST(amount AS DECIMAL(12,2))) AS DOUBLE) AS revenue FROM src GROUP BY status
UNION ALL SELECT 'target', status, COUNT(*), CAST(SUM(CAST(amount AS DECIMAL(12,2))) AS DOUBLE)
FROM repriced GROUP BY status""",
)
def src_04(spark, folder):
    source = orders(spark, folder)
    exact = F.col("amount").cast("decimal(12,2)")

    def run(side, frame):
        result = run_side(spark, SIDE_TEXT, {"orders": frame.withColumn("amount", exact)})
        return result.select(F.lit(side).alias("side"), "*")

    return run("source", source).unionAll(run("target", repriced(source)))


@query(
    "snk_01_export_result",
    f"""{SIDES_SQL} SELECT 5 AS run_id, 'source' AS side, 'legacy' AS schema_name,
  COUNT(*) AS row_count, 5 AS column_count, 'order_id,customer_id,order_date,amount,status' AS columns,
  COUNT(*) AS stored FROM src
UNION ALL SELECT 5, 'target', 'modern', COUNT(*), 2, 'order_id,amount', COUNT(*) FROM shortened""",
)
def snk_01(spark, folder):
    base = scratch_path(spark, "exports")
    source = orders(spark, folder)
    IO.export(source, 5, "source", base, "legacy")
    short = source.filter(F.col("amount") <= 490000).select("order_id", "amount")
    IO.export(short, 5, "target", base, "modern")
    stored = [
        spark.read.parquet(IO.export_path(base, 5, side))
        .agg(F.count("*").alias("stored"))
        .select(F.lit(side).alias("side"), "stored")
        for side in IO.SIDES
    ]
    manifest = IO.manifest(spark, base).join(stored[0].unionAll(stored[1]), "side")
    return manifest.select(
        F.col("run_id").cast("int").alias("run_id"), "side", "schema_name", "row_count",
        "column_count", F.array_join("columns", ",").alias("columns"), "stored",
    )


PART_FIELDS = "p_partkey BIGINT, p_name VARCHAR(8), p_size BIGINT, p_retailprice DECIMAL(12,2)"


def _loose_parts(spark, folder):
    text = [F.col(c).cast("string").alias(c) for c in T.StructType.fromDDL(PART_FIELDS).names]
    return scan(spark, folder, "part").select(*text)


@query(
    "snk_02_truncate_load",
    """SELECT p_partkey, substr(p_name, 1, 8) AS p_name, CAST(p_size AS BIGINT) AS p_size,
  CAST(p_retailprice AS DOUBLE) AS p_retailprice, (SELECT COUNT(*) FROM part) AS rows_loaded
FROM part""",
)
def snk_02(spark, folder):
    path, spec = scratch_path(spark, "load"), T.StructType.fromDDL(PART_FIELDS)
    loose = _loose_parts(spark, folder)
    IO.load(loose.withColumn("p_size", F.lit("0")), spec, path)
    rows = IO.load(loose, spec, path)
    return spark.read.parquet(path).select(
        "p_partkey",
        "p_name",
        "p_size",
        F.col("p_retailprice").cast("double").alias("p_retailprice"),
        F.lit(rows).cast("bigint").alias("rows_loaded"),
    )


@query(
    "snk_03_load_all",
    """SELECT 'parts' AS table_name, COUNT(*) AS rows_loaded FROM part
UNION ALL SELECT 'orders', COUNT(*) FROM orders""",
)
def snk_03(spark, folder):
    base = scratch_path(spark, "load_all")
    frames = {"parts": _loose_parts(spark, folder), "orders": orders(spark, folder)}
    fields = {"parts": PART_FIELDS, "orders": "order_id BIGINT, status VARCHAR(4)"}
    specs = {name: T.StructType.fromDDL(text) for name, text in fields.items()}
    return IO.load_all(frames, specs, base)


@query(
    "snk_04_compare_json",
    """SELECT 1 AS run_id, '{"run_id":1,"source_file":"same.sql","passed":true,"source_rows":' || n
  || ',"target_rows":' || n || ',"columns_match":true,"row_counts_match":true,'
  || '"alignment":"keys: order_id","message":"Reconciliation passed (' || n
  || ' rows, all columns match)","column_diffs":[]}' AS report, 1 AS total_runs, 1 AS passed, 0 AS failed,
  'reports' AS report_folder, '1: Reconciliation passed (' || n || ' rows, all columns match)' AS runs
FROM (SELECT COUNT(*) AS n FROM orders)""",
)
def snk_04(spark, folder):
    source = orders(spark, folder)
    base = scratch_path(spark, "reports")
    results = R.reconcile_runs([R.RunPair(1, "same.sql", source, source)])
    IO.write_reports(results, base)
    summary = spark.read.json(
        f"{base}/summary",
        schema="total_runs INT, passed INT, failed INT, report_path STRING, "
        "runs ARRAY<STRUCT<run_id: INT, message: STRING>>",
    ).withColumns(
        {
            "report_folder": F.element_at(F.split("report_path", "/"), -1),
            "runs": F.array_join(F.transform("runs", lambda r: F.concat_ws(": ", r["run_id"], r["message"])), ", "),
        }
    )
    reports = IO.to_report_json(results).withColumn("run_id", F.col("run_id").cast("int"))
    return reports.withColumns(
        {
            c: summary.select(F.first(c)).scalar()
            for c in ("total_runs", "passed", "failed", "report_folder", "runs")
        }
    )


@query(
    "snk_05_executive_summary",
    f"""WITH results AS ({RUNS_SQL}) SELECT run_id,
  COALESCE(source_file, 'run ' || run_id) AS sql_file,
  CASE WHEN passed THEN 'PASSED' ELSE 'FAILED' END AS status, source_rows, target_rows
FROM results ORDER BY run_id""",
)
def snk_05(spark, folder):
    summary = R.executive_summary(R.reconcile_runs(_pairs(spark, folder)))
    return summary.withColumn("run_id", F.col("run_id").cast("int"))
