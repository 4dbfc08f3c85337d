"""Game folders: which engine, script-wrapped plugin lists, and patching of trees."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank, is_ui_text, text

# Folders that hold copies, marker files of the engines (first match counts).
SKIP_DIRS = ["新しいフォルダー", "新しいフォルダー - コピー", "backup", "backups"]
ENGINES = [("vx-ace", r"(?i)^data/[^/]*\.rvdata2$"), ("vx", r"(?i)^data/[^/]*\.rvdata$"), ("xp", r"(?i)^data/[^/]*\.rxdata$"), ("mz", r"^(www/)?js/rmmz_core\.js$"), ("mv", r"^(www/)?js/rpg_core\.js$"),
           ("mv", r"^www/package\.json$"), ("mv-mz", r"^(www/)?data/"), ("unity-xunity", r"^(BepInEx|AutoTranslator)/")]


def detect_engine(listing: DataFrame) -> DataFrame:
    """(game, engine) of a listing (game, path): the first engine of the list one of whose marker files is there; null for none."""
    ranks = F.lit(None).cast("int")
    for rank, (_, pattern) in reversed(list(enumerate(ENGINES))):
        ranks = F.when(F.col("path").rlike(pattern), rank).otherwise(ranks)
    names = F.array(*[F.lit(e) for e, _ in ENGINES])
    return listing.groupBy("game").agg(F.min(ranks).alias("r")).select("game", F.get(names, F.col("r")).alias("engine"))


def skip_copies(files: DataFrame, path: str = "file") -> DataFrame:
    """Files none of whose folders holds copies."""
    return files.where(~F.arrays_overlap(F.split(text(F.col(path)), "/"), F.array(*[F.lit(d) for d in SKIP_DIRS])))


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, body) of all JSON files below a folder, one row each."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    return skip_copies(df.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("body")))


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, body) of the plugin lists below a folder."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "plugins.js").option("recursiveFileLookup", "true").load(path)
    return skip_copies(df.select(F.col("path").alias("file"), F.regexp_replace(F.decode("content", "UTF-8"), "^\\x{feff}", "").alias("body")))


def write_files(files: DataFrame, folder: str) -> None:
    """Write each (output, body) as a file below a folder that all executors see (a path, not an object store): a new file takes the place of the old one only when it is complete."""
    root = folder.removeprefix("file://")

    def run(rows: Iterator[Row]) -> None:
        for r in rows:
            path = Path(root, r.output)
            path.parent.mkdir(parents=True, exist_ok=True)
            new = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
            new.write_text(r.body, encoding="utf-8", newline="")
            new.replace(path)

    files.foreachPartition(run)


def plugin_list(body: F.Column) -> F.Column:
    """The array inside ``var $plugins = [...];`` as JSON text, '' where there is none."""
    return F.regexp_extract(text(body), r"(?s)^(?:\s|//[^\n]*\n|/\*.*?\*/)*var\s+\$?\w+\s*=\s*(\[.*\])\s*;?\s*$", 1)


def plugin_parameters(files: DataFrame) -> DataFrame:
    """(file, key, source, context) of the enabled plugins' string parameters that could be shown; a parameter that holds JSON gives its strings."""
    plugins = files.select("file", F.posexplode(F.from_json(plugin_list(F.col("body")), "array<struct<name:string,status:boolean,parameters:map<string,string>>>")).alias("i", "p"))
    each = plugins.where("p.status is null or p.status").select("file", "i", F.col("p.name").alias("plugin"), F.explode("p.parameters").alias("param", "value"))
    key = F.concat(F.lit("$["), F.col("i").cast("string"), F.lit("].parameters['"), F.col("param"), F.lit("']"))
    each = each.select("file", key.alias("key"), "value", F.concat(F.lit("rpg_maker_plugin_param_"), F.col("plugin")).alias("context"))
    nested = each.where(F.col("value").rlike(r"^\s*[\[{]"))
    inner = _inner(nested)
    plain = each.where(~F.col("value").rlike(r"^\s*[\[{]")).select("file", "key", F.col("value").alias("source"), "context")
    return plain.unionByName(inner).where(is_ui_text(F.col("source")))


def _inner(nested: DataFrame) -> DataFrame:
    from ..operators.nested import flatten_json, mark_readable

    marked = mark_readable(nested, "value")
    whole = marked.where("not readable").select("file", "key", F.col("value").alias("source"), "context")
    body = marked.where("readable").select("file", "key", "context", F.col("value").alias("_body"))
    leaves = flatten_json(body, "_body", ["file", "key", "context"]).where("kind = 'text'")
    return whole.unionByName(leaves.select("file", F.concat("key", F.expr("substring(path, 2)")).alias("key"), F.col("value").alias("source"), "context"))


# --- patching ---------------------------------------------------------------------------------------------------------

_STEP = re.compile(r"\.([^.\[]+)|\[(\d+)\]|\['((?:[^'])*)'\]")


def path_steps(path: str) -> list[str | int]:
    """Members and positions of ``$.a[1]['b c']``; what is no step is left out."""
    return [int(m[2]) if m[2] is not None else m[1] if m[1] is not None else m[3] for m in _STEP.finditer(path)]


def path_tokens(path: F.Column) -> F.Column:
    """The same as an array of strings, as a column expression."""
    return F.regexp_extract_all(text(path), F.lit(r"\.([^.\[]+)|\[\d+\]|\['[^']*'\]"), F.lit(0))


def _set(root: object, steps: list[str | int], value: str) -> bool:
    at = root
    for step in steps[:-1]:
        try:
            at = at[step]  # type: ignore[index]
        except (KeyError, IndexError, TypeError):
            return False
    last = steps[-1] if steps else None
    if isinstance(at, dict) and last in at or isinstance(at, list) and isinstance(last, int) and last < len(at):
        at[last] = value  # type: ignore[index]
        return True
    return False


def _indent(body: str) -> int | None:
    """Indent by the second to fourth line: 4 for a tab or four blanks and more, 2 for fewer, None where none of them is indented."""
    for row in body.split("\n")[1:4]:
        blanks = len(row) - len(row.lstrip())
        if row.strip() and blanks:
            return 4 if row[0] == "\t" or blanks >= 4 else 2
    return None


_SCRIPT = re.compile(r"^((?:\s|//[^\n]*\n|/\*.*?\*/)*)var\s+(\$?\w+)\s*=\s*(\[.*\])\s*;?\s*$", re.S)


def _unwrap(body: str) -> tuple[object, str | None, str]:
    """(tree, comments before a script-wrapped list or None, name of its variable); raises ValueError for what is no tree."""
    m = _SCRIPT.match(body)
    if m:
        return json.loads(m[3]), m[1].strip("\n"), m[2]
    return json.loads(body), None, ""


def output_path(file: F.Column) -> F.Column:
    """Path of a patched file below the output folder: what follows the last ``data`` folder, else the file's name. A path that would climb out is an error."""
    f = F.replace(text(file), F.lit("\\"), F.lit("/"))
    below = F.regexp_extract(f, r"(?:^|/)data/((?:(?!.*/data/).)*)$", 1)
    out = F.when(below != "", below).otherwise(F.substring_index(f, "/", -1))
    return F.when(out.rlike(r"(^|/)\.\.(/|$)"), F.raise_error(F.concat(F.lit("unsafe output path: "), f)).cast("string")).otherwise(out)


def drift(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status) of every file of a manifest (path, sha256): ``same``, ``modified`` or ``missing``. ``files`` (path, content)."""
    now = files.select("path", F.sha2("content", 256).alias("_now")).groupBy("path").agg(F.max("_now").alias("_now"))
    return manifest.join(now, "path", "left").select("path", F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.lower("sha256"), "same").otherwise("modified").alias("status"))


def patch(files: DataFrame, results: DataFrame) -> DataFrame:
    """(file, body, applied, stale): every file with its results put in at their paths.

    A result with several sub_keys gives one line to each; more keys than lines repeat the last line. A path that is not there is ``stale``; where all are, ``body`` is null and
    nothing should be written. Script-wrapped plugin lists keep their comments (deviation D7: nothing is written over its source). Blank targets are left out. Files are joined by their name: one task holds the results of one file at a time, which are no more than the file's own texts.
    """
    r = results.where(~blank(F.col("target"))).select("file", F.struct("ord", "key", "target", F.coalesce("sub_keys", F.array().cast("array<string>")).alias("sub_keys")).alias("r"))
    last = r.groupBy("file", "r.key").agg(F.max("r").alias("r"))
    per_file = last.groupBy("file").agg(F.array_sort(F.collect_list("r")).alias("rows"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for file, body, rows in zip(part["file"], part["body"], part["rows"]):
                plain = (body or "").lstrip("﻿ \t\r\n")
                try:
                    root, header, variable = _unwrap(plain)
                except ValueError:
                    out.append((file, None, 0, len(rows)))
                    continue
                applied = stale = 0
                for row in rows:
                    keys = list(row["sub_keys"]) or [row["key"]]
                    cut = row["target"].split("\n") if len(keys) > 1 else [row["target"]]
                    if len(cut) > len(keys):
                        cut = [*cut[:len(keys) - 1], "\n".join(cut[len(keys) - 1:])]
                    for k, key in enumerate(keys):
                        ok = _set(root, path_steps(key), cut[min(k, len(cut) - 1)])
                        applied, stale = applied + ok, stale + (not ok)
                indent = _indent(plain)
                if header is None:
                    text_out = json.dumps(root, ensure_ascii=False, indent=indent, separators=None if indent else (",", ":"))
                else:  # a script keeps its comments
                    text_out = (header + "\n" if header else "") + f"var {variable} =\n" + json.dumps(root, ensure_ascii=False, indent=2) + ";\n"
                out.append((file, text_out if applied else None, applied, stale))
            yield pd.DataFrame(out, columns=["file", "body", "applied", "stale"]).astype({"applied": "int64", "stale": "int64"})

    return files.select("file", "body").join(per_file, "file").mapInPandas(run, "file string, body string, applied bigint, stale bigint")


def duplicate_outputs(files: DataFrame, output: F.Column) -> DataFrame:
    """(output, files) of paths that more than one file would be written to: an error before anything is written."""
    return files.select(output.alias("output"), "file").distinct().groupBy("output").agg(F.count(F.lit(1)).alias("files")).where("files > 1")
