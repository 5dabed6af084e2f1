"""Sources and sinks by DataFrame reader and writer."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions.text import object_identity


def sql_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sql, schema, name, kind)`` of the SQL files under a folder; a file without a header goes by its own name."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.sql").text(path)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("sql"))
    found = files.withColumn("id", object_identity(F.col("sql")))
    stem = F.regexp_extract("path", r"([^/]+)\.sql$", 1)
    return found.select("path", "sql", F.coalesce("id.schema", F.lit("dbo")).alias("schema"), F.coalesce("id.name", stem).alias("name"), F.coalesce("id.kind", F.lit("procedure")).alias("kind"))


def sql_folders(spark: SparkSession, folders: list[tuple[str, str, str]]) -> DataFrame:
    """``sql_files`` of several folders ``(path, source_type, source_schema)``, with these two labels; a folder that can't be
    read fails the whole."""
    parts = [sql_files(spark, path).withColumns({"source_type": F.lit(kind), "source_schema": F.lit(schema)}) for path, kind, schema in folders]
    return in_order(parts, "folder_no")


def in_order(parts: list[DataFrame], ordinal: str) -> DataFrame:
    """The rows of all parts by name, with the number of the part, from 0: whoever needs their order has it as a column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(ordinal, F.lit(k)) for k, df in enumerate(parts)))


def dictionary_csv(spark: SparkSession, path: str, keys: list[str], filled: tuple[str, ...] = ()) -> DataFrame:
    """A dictionary file with a header; keys that repeat, case aside, raise. ``filled``: columns that are null where the file
    lacks them."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = {c.upper() for c in df.columns}
    df = df.withColumns({c: F.lit(None).cast("string") for c in filled if c.upper() not in have})
    twice = df.groupBy(*(F.upper(k).alias(k) for k in keys)).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"names that repeat: {[tuple(r)[:-1] for r in twice]}")
    return df


def id_keyed_columns(columns: DataFrame, tables: DataFrame, key: str = "TABLE_ID") -> DataFrame:
    """The columns of a dictionary that names tables by id, with the other columns of their tables; null for unknown ids."""
    one = tables.dropDuplicates([key])
    return columns.join(one.select(key, *(c for c in one.columns if c not in columns.columns)), key, "left")


def looked_up(refs: DataFrame, tables: DataFrame, name: str = "TABLE_NAME", description: str = "DESCRIPTION", order: str = "pos") -> DataFrame:
    """``refs`` with the ``description`` of the table they name, case aside: of several rows the last by ``order``, else empty."""
    last = tables.groupBy(F.upper(name).alias("_t")).agg(F.max_by(description, order).alias("_d"))
    return refs.join(last, F.upper(name) == F.col("_t"), "left").withColumn("description", F.coalesce("_d", F.lit(""))).drop("_t", "_d")


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the ``*.jsonl`` files of a folder and of what ``append_events`` put there, column ``value``; a folder that doesn't exist has none, and whatever
    else keeps it from being listed raises."""
    try:
        return spark.read.option("pathGlobFilter", "{*.jsonl,part-*}").text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string")


def recorded(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows that were recorded as one array of JSON objects; what doesn't fit ``schema`` raises when they are read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def jdbc_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def overwrite_table(df: DataFrame, name: str) -> None:
    """A full refresh of a table, its columns included."""
    df.write.mode("overwrite").option("overwriteSchema", True).saveAsTable(name)


def append_table(df: DataFrame, name: str) -> None:
    """Adds rows to a history table, which the first run creates. Columns go by name and have to be the table's own: a row
    that doesn't fit raises, and what is there is never written over."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        df.write.mode("errorifexists").saveAsTable(name)
        return
    held = spark.table(name)
    if sorted(held.dtypes) != sorted(df.dtypes):
        raise ValueError(f"{name} has {sorted(held.dtypes)}, not {sorted(df.dtypes)}")
    df.select(*held.columns).write.mode("append").insertInto(name)


def snapshot(spark: SparkSession, source: str, target: str) -> DataFrame:
    """A table as it is now, under another name, in place of an earlier snapshot."""
    overwrite_table(spark.table(source), target)
    return spark.table(target)


def append_events(events: DataFrame, path: str) -> None:
    """One line of JSON an event, null fields included, added to a folder that ``event_lines`` reads."""
    lines = events.select(F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("append").text(path)
