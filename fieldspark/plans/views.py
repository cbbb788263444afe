"""Geometric views over the driver's tables, as DataFrames and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "pts2": "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, round(p_retailprice*10)-9000 AS y FROM part",
    "boxes2": """SELECT s_suppkey AS box_id,
        CAST(s_suppkey*7%50 - 1 - s_suppkey%4 AS DOUBLE) AS x_lo, CAST(s_suppkey*7%50 + 2 + s_suppkey%3 AS DOUBLE) AS x_hi,
        CAST(s_suppkey*131%1000 - 20 - s_suppkey%11 AS DOUBLE) AS y_lo, CAST(s_suppkey*131%1000 + 30 + s_suppkey%7 AS DOUBLE) AS y_hi FROM supplier""",
    "balls2": "SELECT s_suppkey AS ball_id, CAST(s_suppkey*7%50 AS DOUBLE) AS cx, CAST(s_suppkey*131%1000 AS DOUBLE) AS cy, CAST(5+s_suppkey%20 AS DOUBLE) AS r FROM supplier",
    "ell2": """SELECT s_suppkey AS ell_id, CAST(s_suppkey*7%50 AS DOUBLE) AS mx, CAST(s_suppkey*131%1000 AS DOUBLE) AS my,
        CAST(4 AS DOUBLE) AS sxx, CAST(4*(s_suppkey%3-1) AS DOUBLE) AS sxy, CAST(256 AS DOUBLE) AS syy FROM supplier""",
    "coo": "SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2",
    "batches": "SELECT l_orderkey AS batch, count(*) AS length FROM lineitem GROUP BY 1",
    "vecs": "SELECT vec_id AS id, embedding AS p, label FROM embeddings",
}
#: The time views differ between the dialects only in how they take seconds.
_GRID = "SELECT CAST(floor({s}/86400) AS BIGINT)-19723 AS i, CAST(floor({s}/3600) AS BIGINT)%24 AS j, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2"
_SERIES = "SELECT user_id AS series_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS k, round(value*100) AS y FROM events"
ORACLE = SQL | {"grid2": _GRID.format(s="epoch(ts)"), "series": _SERIES}
SPARK = SQL | {"grid2": _GRID.format(s="(unix_micros(CAST(ts AS TIMESTAMP))/1000000)"), "series": _SERIES}
TABLES = {"pts2": "part", "boxes2": "supplier", "balls2": "supplier", "ell2": "supplier", "coo": "lineitem", "batches": "lineitem", "vecs": "embeddings", "grid2": "events", "series": "events"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; the base table is passed into the query, so nothing global is registered."""
    table = TABLES[name]
    base = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    text = SPARK[name].replace(f"FROM {table}", "FROM {base}")
    return spark.sql(text.replace("{base}", "{base}"), base=base)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(names: list[str], body: str) -> str:
    """Oracle SQL with the named views as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({ORACLE[n]})" for n in names) + "\n" + body


def recursive(names: list[str], body: str) -> str:
    """As with_views, for bodies whose table expressions refer to themselves."""
    return with_views(names, body).replace("WITH ", "WITH RECURSIVE ", 1)


def grid_of(df: DataFrame) -> DataFrame:
    """The grid view as (i, j, v) with plain long indices."""
    return df.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v")
