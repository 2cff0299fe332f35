"""Domain tables derived from the given tables, for queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the last day that the example ledger looks at.
UNTIL = "2001-12-31"

VIEWS = {
    "tickets": "SELECT o_orderkey AS id_documento, o_custkey AS id_empresa, CAST(o_orderdate AS DATE) AS fecha, CAST(o_totalprice AS DECIMAL(18,2)) AS total FROM orders",
    "labelled": "SELECT o_orderkey AS id_documento, c_mktsegment AS categoria, o_orderpriority AS etiqueta FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'",
    "companies": "SELECT c_custkey AS id_empresa, c_name AS nombre FROM customer WHERE c_acctbal >= 0",
    "recurring": """SELECT c_custkey AS id_evento, CASE c_custkey % 4 WHEN 0 THEN 'MENSUAL' WHEN 1 THEN 'SEMESTRAL' WHEN 2 THEN 'ANUAL' ELSE 'UNICA' END AS frecuencia,
        CAST(1 + c_custkey % 31 AS INT) AS dia_mes, DATE '1995-01-01' + CAST(c_custkey % 700 AS INT) AS fecha_inicio,
        CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE DATE '1999-12-31' END AS fecha_fin, DATE '1995-01-01' + CAST(c_custkey % 730 AS INT) AS fecha_unica,
        CAST(c_acctbal AS DECIMAL(18,2)) AS importe, c_name AS nombre, c_mktsegment AS categoria, 'recurrente' AS etiqueta FROM customer""",
    "items": "SELECT l_orderkey AS id_documento, l_linenumber AS linea, l_partkey AS pieza, l_suppkey AS proveedor, CAST(l_extendedprice AS DECIMAL(18,2)) AS importe, CAST(l_discount * 100 AS DECIMAL(18,2)) AS pct, CAST(l_quantity AS DECIMAL(18,3)) AS unidades, l_returnflag AS codigo, CAST(l_tax AS DECIMAL(18,2)) AS tipo FROM lineitem",
    "hist": "SELECT event_id AS id_normalizacion, user_id AS id_documento, value > 10 AS ok, ts AS fecha, event_type AS origen, value AS valor, props AS documento FROM events",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table; its SQL is run over the tables it names."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "lineitem", "events") if f" {t}" in VIEWS[name]}
    sql = VIEWS[name]
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **tables)


def with_views(sql: str, *names: str) -> str:
    """The same tables in front of a query's SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + ("," if sql.lstrip().upper().startswith(",") else "") + "\n" + sql.lstrip().lstrip(",")
