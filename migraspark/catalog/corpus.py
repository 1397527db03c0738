"""Lineage and text checks with every document as the SQL text of one run.

The second text of a run is the page of the same number. The test texts are prose, so the base
tables of these queries are words that follow "from" or "join" in it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from migraspark.catalog import query
from migraspark.functions import text as X
from migraspark.operators import lineage as L
from migraspark.sources.tables import cores, scan, spread

BASE = ("the", "of", "de", "zz_unused")


def runs(spark, folder):
    pages = scan(spark, folder, "pages").select("page_id", F.col("html").alias("target_sql"))
    documents = scan(spark, folder, "documents").select(
        F.col("doc_id").alias("run_id"),
        F.concat("source", F.lit(".sql")).alias("source_file"),
        F.col("text").alias("source_sql"),
    )
    joined = documents.join(pages, F.col("run_id") == F.col("page_id"), "left").drop("page_id")
    return spread(joined.withColumn("target_sql", F.coalesce("target_sql", F.lit(""))), cores(spark))


def _found(text: str) -> str:
    hits = (
        f"list_concat(regexp_extract_all({text}, '{L.FROM_PATTERN}', 1), "
        f"regexp_extract_all({text}, '{L.JOIN_PATTERN}', 1))"
    )
    words = ", ".join(f"'{w}'" for w in L.NOT_TABLES)
    return f"list_sort(list_distinct([lower(x) FOR x IN {hits} IF lower(x) NOT IN ({words})]))"


def _ctes(text: str) -> str:
    return f"[lower(x) FOR x IN regexp_extract_all({text}, '{L.CTE_PATTERN}', 1)]"


BASE_LIST = ", ".join(f"'{name}'" for name in BASE)
RUNS_SQL = f"""WITH runs AS (SELECT doc_id AS run_id, source || '.sql' AS source_file,
  text AS source_sql, COALESCE(html, '') AS target_sql
  FROM documents LEFT JOIN pages ON doc_id = page_id),
inputs AS (SELECT *, list_sort(list_distinct(list_concat(s, t))) AS input_tables FROM (
  SELECT *, {_found("source_sql")} AS s, {_found("target_sql")} AS t FROM runs))"""


@query(
    "lin_01_table_refs",
    f"""SELECT doc_id, array_to_string({_found("text")}, ',') AS tables FROM documents""",
)
def lin_01(spark, folder):
    refs = F.array_join(L.table_refs(F.col("text")), ",")
    return spread(scan(spark, folder, "documents"), cores(spark)).select("doc_id", refs.alias("tables"))


@query(
    "lin_02_run_inputs",
    f"{RUNS_SQL} SELECT run_id, array_to_string(input_tables, ',') AS tables FROM inputs",
)
def lin_02(spark, folder):
    inputs = L.run_inputs(runs(spark, folder), BASE)
    return inputs.select("run_id", F.array_join("input_tables", ",").alias("tables"))


@query(
    "lin_03_base_flag",
    f"""{RUNS_SQL} SELECT run_id, x AS table_name, x IN ({BASE_LIST}) AS is_base,
  list_contains(list_concat({_ctes("source_sql")}, {_ctes("target_sql")}), x) AS is_cte
FROM (SELECT *, UNNEST(input_tables) AS x FROM inputs)""",
)
def lin_03(spark, folder):
    return L.table_usage(runs(spark, folder), BASE)


@query(
    "lin_04_lineage_edges",
    f"""{RUNS_SQL} SELECT run_id, 'legacy.' || x AS src, 'migration_run_' || run_id AS dst,
  source_file AS via FROM (SELECT *, UNNEST(input_tables) AS x FROM inputs)
UNION ALL SELECT run_id, 'migration_run_' || run_id, 'modern.query_result', 'generated_sql'
FROM runs""",
)
def lin_04(spark, folder):
    return L.lineage_edges(runs(spark, folder), "legacy", "modern")


@query(
    "lin_05_usage_matrix",
    f"""{RUNS_SQL}, uses AS (SELECT run_id, x AS table_name
  FROM (SELECT *, UNNEST(input_tables) AS x FROM inputs) WHERE x IN ({BASE_LIST}))
SELECT base.table_name, run_id, COALESCE(CAST(run_id AS VARCHAR), '—') AS used_by
FROM (SELECT UNNEST([{BASE_LIST}]) AS table_name) base LEFT JOIN uses
  ON uses.table_name = base.table_name""",
)
def lin_05(spark, folder):
    return L.usage_matrix(runs(spark, folder), BASE)


@query(
    "lin_06_overview_rows",
    f"""{RUNS_SQL} SELECT run_id, source_file, CASE WHEN len(input_tables) = 0 THEN '-'
  ELSE array_to_string(input_tables[1:4], ', ')
    || CASE WHEN len(input_tables) > 4 THEN ', …' ELSE '' END END AS tables_read FROM inputs""",
)
def lin_06(spark, folder):
    return L.overview_rows(runs(spark, folder))


@query(
    "lin_07_lineage_document",
    f"""{RUNS_SQL} SELECT run_id, '{{"run_id":' || run_id || ',"source_file":"' || source_file
  || '","source_schema":"legacy","target_schema":"modern","input_tables":['
  || array_to_string(['"' || x || '"' FOR x IN input_tables], ',') || '],"base_tables":['
  || array_to_string(['"' || x || '"' FOR x IN input_tables IF x IN
       ('customers', 'orders', 'products', 'ecommerce')], ',')
  || '],"edges":[' || array_to_string(list_concat(
       ['{{"from":"legacy.' || x || '","to":"migration_run_' || run_id || '","via":"' || source_file
        || '"}}' FOR x IN input_tables],
       ['{{"from":"migration_run_' || run_id
        || '","to":"modern.query_result","via":"generated_sql"}}']), ',') || ']}}' AS document
FROM inputs""",
)
def lin_07(spark, folder):
    return L.lineage_documents(runs(spark, folder), "legacy", "modern")


# ---------------------------------------------------------------- texts


def documents(spark, folder):
    return spread(scan(spark, folder, "documents"), cores(spark))


PROCEDURAL_SQL = """CASE lang WHEN 'en' THEN 'create or replace procedure p() ' || text
  WHEN 'fr' THEN 'begin ' || text || ' declare x' WHEN 'de' THEN text || ' as $$' ELSE text END"""


def _procedural():
    text, lang = F.col("text"), F.col("lang")
    return (
        F.when(lang == "en", F.concat(F.lit("create or replace procedure p() "), text))
        .when(lang == "fr", F.concat(F.lit("begin "), text, F.lit(" declare x")))
        .when(lang == "de", F.concat(text, F.lit(" as $$")))
        .otherwise(text)
    )


def _any(text: str, markers) -> str:
    return " OR ".join(f"contains(upper({text}), '{m}')" for m in markers)


@query(
    "txt_01_procedural_output_flag",
    f"""SELECT doc_id, {_any(PROCEDURAL_SQL, X.OUTPUT_MARKERS)}
  OR (contains(upper({PROCEDURAL_SQL}), 'BEGIN') AND contains(upper({PROCEDURAL_SQL}), 'DECLARE'))
  AS procedural FROM documents""",
)
def txt_01(spark, folder):
    flag = X.is_procedural_output(_procedural())
    return documents(spark, folder).select("doc_id", flag.alias("procedural"))


@query(
    "txt_02_procedural_source_flag",
    f"""SELECT doc_id, {_any("text", X.SOURCE_MARKERS)} AS procedural,
  regexp_matches(upper(text), '\\b(PROCEDURE|FUNCTION|BEGIN|END|DECLARE|EXIT HANDLER|LANGUAGE PLPGSQL)\\b')
    OR contains(upper(text), 'AS $$') AS whole_words FROM documents""",
)
def txt_02(spark, folder):
    text = F.col("text")
    return documents(spark, folder).select(
        "doc_id",
        X.is_procedural_source(text).alias("procedural"),
        X.is_procedural_source(text, whole_words=True).alias("whole_words"),
    )


STRIP_SQL = r"regexp_replace({}, '^\s+|\s+\z', '', 'g')"


@query(
    "txt_03_strip_fence",
    f"""SELECT doc_id, {STRIP_SQL.format("text")} AS code, {STRIP_SQL.format("text")} AS plain
FROM documents""",
)
def txt_03(spark, folder):
    fenced = F.concat(F.lit(" ```sql\n"), F.col("text"), F.lit("\n```\n"))
    return documents(spark, folder).select(
        "doc_id",
        X.strip_fence(fenced).alias("code"),
        X.strip_fence(F.col("text")).alias("plain"),
    )


COMMENTED_SQL = r"'-- head' || chr(10) || replace(text, '. ', chr(10) || '  -- ') || ' ;;' || chr(10)"


@query(
    "txt_04_clean_sql",
    f"""SELECT doc_id, regexp_replace({STRIP_SQL.format(
        "array_to_string([l FOR l IN string_split_regex(" + COMMENTED_SQL
        + r", '\r\n|\r|\n') IF NOT regexp_matches(l, '^\s*--')], chr(10))")}, ';+\\z', '') AS code
FROM documents""",
)
def txt_04(spark, folder):
    body = F.replace(F.col("text"), F.lit(". "), F.lit("\n  -- "))
    commented = F.concat(F.lit("-- head\n"), body, F.lit(" ;;\n"))
    return documents(spark, folder).select("doc_id", X.clean_sql(commented).alias("code"))


@query(
    "txt_05_validate_request",
    f"""WITH requests AS (SELECT doc_id, CASE WHEN n_chars < 150 THEN ' ' || chr(10)
  WHEN n_chars > 15000 THEN repeat(text, 70) ELSE text END AS code,
  NULLIF(lang, 'de') AS source, CASE lang WHEN 'es' THEN '' WHEN 'fr' THEN 'fr' ELSE 'x' END AS target
  FROM documents)
SELECT doc_id, concat_ws('; ',
  CASE WHEN {STRIP_SQL.format("code")} = '' THEN '{X.EMPTY_CODE}' END,
  CASE WHEN length(code) > {X.MAX_CODE_LENGTH} THEN '{X.LONG_CODE}' END,
  CASE WHEN COALESCE(source, '') = '' THEN '{X.NO_SOURCE}' END,
  CASE WHEN target = '' THEN '{X.NO_TARGET}' END,
  CASE WHEN source = target AND target <> '' THEN '{X.SAME_SIDES}' END) AS errors FROM requests""",
)
def txt_05(spark, folder):
    size, text = F.col("n_chars"), F.col("text")
    code = F.when(size < 150, " \n").when(size > 15000, F.repeat(text, F.lit(70))).otherwise(text)
    target = F.when(F.col("lang") == "es", "").when(F.col("lang") == "fr", "fr").otherwise("x")
    errors = X.validate_request(code, F.nullif("lang", F.lit("de")), target)
    return documents(spark, folder).select("doc_id", F.array_join(errors, "; ").alias("errors"))


@query(
    "txt_06_excerpt",
    f"""SELECT doc_id, CASE WHEN length(s) > 2500
    THEN substr(s, 1, 2500) || chr(10) || '-- ... truncated ...' ELSE s END AS sql_excerpt,
  CASE WHEN length(text) > 12000 THEN substr(text, 1, 12000) || chr(10) || chr(10)
    || '… _(truncated)_' ELSE text END AS preview
FROM (SELECT *, {STRIP_SQL.format("text")} AS s FROM documents)""",
)
def txt_06(spark, folder):
    text = F.col("text")
    return documents(spark, folder).select(
        "doc_id",
        X.excerpt(X.strip_space(text), X.SQL_EXCERPT, X.SQL_EXCERPT_MARK).alias("sql_excerpt"),
        X.excerpt(text, X.PREVIEW_EXCERPT, X.PREVIEW_EXCERPT_MARK).alias("preview"),
    )


@query(
    "txt_07_strip_precision",
    "SELECT doc_id, 'a DATETIME, b TIMESTAMP, c timestamp ' || text || ' DATETIME' AS ddl FROM documents",
)
def txt_07(spark, folder):
    ddl = F.concat(
        F.lit("a DATETIME(0), b Timestamp(6), c timestamp "), F.col("text"), F.lit(" datetime(3)")
    )
    return documents(spark, folder).select("doc_id", X.strip_precision(ddl).alias("ddl"))


@query(
    "txt_08_ddl_table_name",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 't_' || doc_id WHEN 'fr' THEN 'm_' || doc_id
  WHEN 'de' THEN 's_' || doc_id END AS table_name FROM documents""",
)
def txt_08(spark, folder):
    name = F.concat_ws("_", F.lit(""), F.col("doc_id").cast("string"))
    head = (
        F.when(F.col("lang") == "en", F.concat(F.lit("create table t"), name))
        .when(F.col("lang") == "fr", F.concat(F.lit("CREATE MULTISET TABLE m"), name))
        .when(F.col("lang") == "de", F.concat(F.lit("Create set\n table s"), name))
        .otherwise("")
    )
    ddl = F.concat(head, F.lit(" ("), F.col("text"), F.lit(")"))
    return documents(spark, folder).select("doc_id", X.ddl_table_name(ddl).alias("table_name"))


@query(
    "txt_09_code_lengths",
    """SELECT doc_id AS run_id, length(text) AS code_length_original,
  length(html) AS code_length_generated FROM documents LEFT JOIN pages ON doc_id = page_id""",
)
def txt_09(spark, folder):
    pages = scan(spark, folder, "pages").select("page_id", F.length("html").alias("generated"))
    texts = documents(spark, folder).select("doc_id", F.length("text").alias("original"))
    joined = texts.join(pages, F.col("doc_id") == F.col("page_id"), "left")
    return joined.select(
        F.col("doc_id").alias("run_id"),
        F.col("original").cast("bigint").alias("code_length_original"),
        F.col("generated").cast("bigint").alias("code_length_generated"),
    )
