"""Views over the data directories that several queries and their SQL share, defined side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contexts import context_name
from ..functions.text import text
from ..runtime import table

SQL_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries with the bare name of their context."""
    e = table(spark, d, "entries")
    return e.select("file", "key", text(F.col("source")).alias("source"), context_name(F.col("context")).alias("context"), text(F.col("context_text")).alias("context_text"), "sub_keys", "ord")


def results(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "results")
    return r.select("file", "key", text(F.col("source")).alias("source"), text(F.col("target")).alias("target"), context_name(F.col("context")).alias("context"), "sub_keys", "ord", F.lower("target_lang").alias("target_lang"))


#: the same as common table expressions
ENTRIES = "e as (select file, key, coalesce(source, '') as source, regexp_extract(coalesce(context, ''), 'rpg_maker_[A-Za-z0-9_]+') as context, coalesce(context_text, '') as context_text, sub_keys, ord from entries)"
RESULTS = "r as (select file, key, coalesce(source, '') as source, coalesce(target, '') as target, regexp_extract(coalesce(context, ''), 'rpg_maker_[A-Za-z0-9_]+') as context, sub_keys, ord, lower(target_lang) as target_lang from results)"


def quote_list(names: list[str]) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)
