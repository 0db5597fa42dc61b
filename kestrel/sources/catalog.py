"""Catalog metadata as DataFrames.

Metadata (table and column lists) is bounded by the number of tables and
columns, never by data volume; it is read from the session catalog or from
table schemas and turned into small DataFrames so the rest of the profile
can join it with per-table statistics computed on the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.scalars import name_part, nullable_flag
from kestrel.sources.tables import TABLES, table

TABLE_SCHEMA = ("catalog string, schema string, name string, full_name string, "
                "table_type string, comment string")
COLUMN_SCHEMA = ("table_name string, ordinal_position int, column_name string, "
                 "data_type string, comment string, is_nullable string")
KEPT_TABLE_TYPES = ("MANAGED", "EXTERNAL")


def catalog_tables(spark: SparkSession, database: str, catalog: str = "spark_catalog", types=KEPT_TABLE_TYPES) -> DataFrame:
    """S7 over the session catalog: tables of these types in a database (views
    filtered out, P7, unless asked for), sorted by name (T2)."""
    rows = [(catalog, database, t.name, f"{catalog}.{database}.{t.name}", t.tableType, t.description)
            for t in spark.catalog.listTables(database)]
    df = spark.createDataFrame(rows, TABLE_SCHEMA)
    return df.where(F.col("table_type").isin(*types)).orderBy("name")


def catalog_columns(spark: SparkSession, database: str) -> DataFrame:
    """S8 over the session catalog, ordered by table and position."""
    rows = []
    for t in spark.catalog.listTables(database):
        for i, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}"), start=1):
            rows.append((t.name, i, c.name, c.dataType, c.description, "YES" if c.nullable else "NO"))
    return spark.createDataFrame(rows, COLUMN_SCHEMA).orderBy("table_name", "ordinal_position")


def parquet_tables(spark: SparkSession, sf_dir: str, names=TABLES,
                   catalog: str = "files", schema: str = "testdata") -> DataFrame:
    """S7 for a folder of parquet tables: each is an EXTERNAL table."""
    rows = [(catalog, schema, n, f"{catalog}.{schema}.{n}", "EXTERNAL", None) for n in names]
    return spark.createDataFrame(rows, TABLE_SCHEMA).orderBy("name")


def parquet_columns(spark: SparkSession, sf_dir: str, names=TABLES) -> DataFrame:
    """S8 for a folder of parquet tables, from each file's schema."""
    rows = []
    for n in names:
        for i, f in enumerate(table(spark, sf_dir, n).schema.fields, start=1):
            rows.append((n, i, f.name, f.dataType.simpleString(), None, "YES" if f.nullable else "NO"))
    return spark.createDataFrame(rows, COLUMN_SCHEMA).orderBy("table_name", "ordinal_position")


def with_nullable(columns: DataFrame) -> DataFrame:
    """boolean ``nullable`` from the YES / NO / NULL text."""
    return columns.withColumn("nullable", nullable_flag("is_nullable"))


def table_lookup(tables: DataFrame, full_name: str) -> DataFrame:
    """One table by three-part name (F20 split), or no row."""
    parts = F.split(F.lit(full_name), r"\.")
    return tables.where((F.col("catalog") == F.element_at(parts, 1))
                        & (F.col("schema") == F.element_at(parts, 2))
                        & (F.col("name") == F.element_at(parts, 3)))


def split_full_name(df: DataFrame, col: str = "full_name") -> DataFrame:
    """F20 as columns."""
    return df.select("*", name_part(col, 1).alias("catalog_part"), name_part(col, 2).alias("schema_part"),
                     name_part(col, 3).alias("table_part"))


def database_exists(spark: SparkSession, database: str) -> bool:
    """S10."""
    return spark.catalog.databaseExists(database)


def table_exists(spark: SparkSession, name: str, database: str | None = None) -> bool:
    """S10."""
    return spark.catalog.tableExists(f"{database}.{name}" if database else name)


def browse(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Sorted catalogs and databases."""
    cats = spark.createDataFrame([(c.name,) for c in spark.catalog.listCatalogs()], "catalog string")
    dbs = spark.createDataFrame([(d.name, d.catalog) for d in spark.catalog.listDatabases()],
                                "database string, catalog string")
    return cats.orderBy("catalog"), dbs.orderBy("catalog", "database")
