"""CSV stores of texts, results, memories and glossaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank, text

UNIT = "\x1f"
# Both sides keep quotes, line breaks and outer blanks inside cells.
READ = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "encoding": "UTF-8"}
WRITE = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": "", "encoding": "UTF-8"}

ENTRY_COLUMNS = ["file", "key", "source", "context", "context_text", "sub_keys"]
RESULT_COLUMNS = ["file", "key", "source", "target", "context", "sub_keys"]
MEMORY_COLUMNS = ["source", "target", "source_lang", "target_lang", "provider", "context", "updated_at"]


def read_csv(spark: SparkSession, path: str | list[str], required: list[str], optional: list[str]) -> DataFrame:
    """All columns as strings, '' for null; missing optional columns are added, missing required ones are an error."""
    df = spark.read.options(**READ).csv(path)
    df = df.select([F.col(f"`{c}`").alias(c.lstrip("﻿").strip()) for c in df.columns])
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"{path}: no column {', '.join(lacking)}")
    for c in optional:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    return df.na.fill("")


def _keys(df: DataFrame) -> DataFrame:
    return df.withColumn("sub_keys", F.when(F.col("sub_keys") == "", F.array().cast("array<string>")).otherwise(F.split("sub_keys", UNIT)))


def read_entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Texts; rows without file or key are left out. Keys of merged lines are kept (deviation D1)."""
    df = read_csv(spark, path, ["file", "key", "source"], ["context", "context_text", "sub_keys"])
    return _keys(df.where(~blank(F.col("file")) & ~blank(F.col("key"))).select(*ENTRY_COLUMNS))


def read_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Results; columns beyond the fixed ones go to the map ``extra``."""
    df = read_csv(spark, path, ["file", "key", "source", "target"], ["context", "sub_keys"])
    more = [c for c in df.columns if c not in RESULT_COLUMNS]
    extra = F.map_from_arrays(F.array(*[F.lit(c) for c in more]), F.array(*[F.col(f"`{c}`") for c in more])) if more else F.create_map().cast("map<string,string>")
    return _keys(df.where(~blank(F.col("file")) & ~blank(F.col("key"))).withColumn("extra", extra).select(*RESULT_COLUMNS, "extra"))


def write_entries(df: DataFrame, path: str) -> None:
    df.select(*ENTRY_COLUMNS[:-1], F.array_join("sub_keys", UNIT).alias("sub_keys")).write.mode("overwrite").options(**WRITE).csv(path)


def write_results(df: DataFrame, path: str, extra: list[str] | None = None) -> None:
    """The fixed columns and those of ``extra``; without a list, every key that occurs, in order (a set of column names, which stays small)."""
    if extra is None:
        extra = sorted(r[0] for r in df.select(F.explode(F.map_keys("extra"))).distinct().collect()) if "extra" in df.columns else []
    more = [text(F.try_element_at("extra", F.lit(c))).alias(c) for c in extra]
    df.select(*RESULT_COLUMNS[:-1], F.array_join("sub_keys", UNIT).alias("sub_keys"), *more).write.mode("overwrite").options(**WRITE).csv(path)


def read_memory(spark: SparkSession, path: str | list[str]) -> DataFrame:
    df = read_csv(spark, path, ["source", "target"], MEMORY_COLUMNS[2:])
    return df.select(*MEMORY_COLUMNS[:-1], F.try_to_timestamp("updated_at").alias("updated_at"))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Glossary rows with their place; one file, small enough for one task."""
    df = read_csv(spark, path, ["term", "translation"], ["note", "category"])
    return df.select("term", "translation", "note", "category", (F.monotonically_increasing_id() + 2).alias("line_no"))


def read_rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Ordered corrections: blank finds dropped, blank replacements kept, repeated ones kept. A rule list is small by nature."""
    df = read_csv(spark, path, ["find", "replace"], []).select("find", "replace", F.monotonically_increasing_id().alias("o"))
    return [(r.find.strip(), r.replace.strip()) for r in df.where(~blank(F.col("find"))).orderBy("o").collect()]


def write_namebox(df: DataFrame, path: str) -> None:
    """Names and translations in order of the names."""
    df.select("original", "translation").where("translation <> ''").orderBy("original").write.mode("overwrite").options(**WRITE).csv(path)


def read_namebox(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path, ["original", "translation"], []).select("original", "translation", F.monotonically_increasing_id().alias("o"))
    return df.where(~blank(F.col("original")) & ~blank(F.col("translation"))).groupBy("original").agg(F.max_by("translation", "o").alias("translation"))
