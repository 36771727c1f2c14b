"""Schema documents <-> flat catalogs.

A schema document is the nested JSON form of one database's catalog
(``{"databaseType", "enums": [...], "tables": [{"name", "columns": [...]}]}``
with the source's field names). Many documents are read in one distributed
scan and flattened with ``posexplode``; absent fields read as null and absent
flags as false.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_SCHEMA = """
db_id string, databaseType string,
enums array<struct<name:string, values:array<string>>>,
tables array<struct<name:string, columns:array<struct<
  name:string, type:string, varchar:string, nullable:boolean, default:string, isPrimary:boolean,
  isUnique:boolean, foreignKey:struct<table:string,column:string>, enum:string, isGenerated:boolean,
  allowedValues:array<string>>>>>
"""


def read_schema_docs(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S3: documents -> (schema_columns, schema_enums, bad documents). ``db_id`` comes from the document or,
    when absent, from the file path. A document that can't be read gives its path and text in the third
    frame and nothing in the others."""
    docs = (spark.read.schema(DOC_SCHEMA + ", _corrupt_record string").option("multiLine", multi_line).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
            .withColumn("_path", F.col("_metadata.file_path")).withColumn("db_id", F.coalesce("db_id", "_path")))
    # a data field stays referenced next to the corrupt-record column (Spark refuses scans of that column alone)
    text = F.concat("_corrupt_record", F.substring(F.coalesce("databaseType", F.lit("")), 1, 0))
    bad = docs.where(text.isNotNull()).select(F.col("_path").alias("path"), text.alias("document"))
    docs = docs.where(text.isNull())
    t = docs.select("db_id", F.posexplode_outer("tables").alias("tpos", "t")).where("t IS NOT NULL")
    c = t.select("db_id", F.col("t.name").alias("table_name"), F.posexplode_outer("t.columns").alias("cpos", "c"))
    cols = c.where("c IS NOT NULL").select(
        "db_id", "table_name", (F.col("cpos") + 1).cast("long").alias("ordinal"),
        F.col("c.name").alias("column_name"), F.col("c.type").alias("col_type"),
        F.col("c.varchar").cast("int").alias("varchar_len"),
        F.coalesce("c.nullable", F.lit(False)).alias("nullable"), F.col("c.default").alias("col_default"),
        F.coalesce("c.isPrimary", F.lit(False)).alias("is_primary"),
        F.coalesce("c.isUnique", F.lit(False)).alias("is_unique"),
        F.coalesce("c.isGenerated", F.lit(False)).alias("is_generated"),
        F.col("c.enum").alias("enum_name"), F.col("c.foreignKey.table").alias("fk_table"),
        F.col("c.foreignKey.column").alias("fk_column"), F.col("c.allowedValues").alias("allowed_values"))
    enums = (docs.select("db_id", F.explode_outer("enums").alias("e")).where("e IS NOT NULL")
             .select("db_id", F.col("e.name").alias("enum_name"), F.explode_outer("e.values").alias("enum_value")))
    return cols, enums, bad


def schema_docs(cols: DataFrame, enums: DataFrame | None = None, database_type: str = "postgres") -> DataFrame:
    """Flat catalog -> one JSON document per database (columns in ordinal order, tables by
    name, with ``allowed_values`` where the catalog has them). Functions and triggers are not part of the document."""
    allowed = [F.col("allowed_values").alias("allowedValues")] if "allowed_values" in cols.columns else []
    col = F.struct(
        F.col("ordinal"),
        F.struct(F.col("column_name").alias("name"), F.col("col_type").alias("type"),
                 F.col("varchar_len").cast("string").alias("varchar"), F.col("nullable"),
                 F.col("col_default").alias("default"), F.col("is_primary").alias("isPrimary"),
                 F.col("is_unique").alias("isUnique"),
                 F.when(F.col("fk_table").isNotNull(), F.struct(F.col("fk_table").alias("table"),
                                                                F.col("fk_column").alias("column"))).alias("foreignKey"),
                 F.col("enum_name").alias("enum"), F.col("is_generated").alias("isGenerated"), *allowed).alias("c"))
    per_table = (cols.groupBy("db_id", "table_name").agg(F.sort_array(F.collect_list(col)).alias("cs"))
                 .select("db_id", F.struct(F.col("table_name").alias("name"), F.col("cs.c").alias("columns")).alias("t")))
    tables = per_table.groupBy("db_id").agg(F.sort_array(F.collect_list("t")).alias("tables"))
    if enums is not None:
        e = (enums.groupBy("db_id", "enum_name").agg(F.sort_array(F.collect_list("enum_value")).alias("values"))
             .select("db_id", F.struct(F.col("enum_name").alias("name"), "values").alias("e"))
             .groupBy("db_id").agg(F.sort_array(F.collect_list("e")).alias("enums")))
        tables = tables.join(e, "db_id", "left")
    else:
        tables = tables.withColumn("enums", F.lit(None))
    return tables.select("db_id", F.to_json(F.struct(
        F.col("db_id"), F.lit(database_type).alias("databaseType"),
        F.coalesce("enums", F.array().cast("array<struct<name:string,values:array<string>>>")).alias("enums"),
        "tables")).alias("doc"))


def write_schema_docs(cols: DataFrame, path: str, enums: DataFrame | None = None,
                      database_type: str = "postgres") -> None:
    """S10 sink: JSON lines, one document per database, partitioned by nothing (documents are rows)."""
    schema_docs(cols, enums, database_type).select("doc").write.mode("error").text(path)
