"""Command line: scan, extract, translate, pipeline, auto, apply, diff, retry, validate. Each is a thin layer over the library."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import glossary, results
from .operators.batching import auto_batch_size
from .plans.pipeline import Options, run, translate_names
from .runtime import ship, store
from .sources import csv_store, games, json_tree


def numbered(df: DataFrame) -> DataFrame:
    """Rows of a store with their order."""
    return df.withColumn("ord", F.monotonically_increasing_id())


def _texts(spark: SparkSession, game: str) -> DataFrame:
    """Entries of all trees and plugin lists of a game."""
    trees = json_tree.extract(games.read_json_files(spark, game))
    plugins = games.plugin_parameters(games.read_scripts(spark, game))
    return trees.unionByName(plugins.select("file", "key", "source", "context", F.array().cast("array<string>").alias("sub_keys"), F.lit("").alias("context_text")))


def scan(spark: SparkSession, a: argparse.Namespace) -> int:
    e = numbered(_texts(spark, a.game))
    contexts = {r.context: r.entries for r in results.scan_contexts(e).orderBy("context").collect()}
    files = [[r.file, r.entries] for r in results.top_files(e).collect()]
    print(json.dumps({"entries": sum(contexts.values()), "contexts": contexts, "top_files": files}, ensure_ascii=False, indent=1))
    return 0


def extract(spark: SparkSession, a: argparse.Namespace) -> int:
    csv_store.write_entries(_texts(spark, a.game), a.out)
    for r in json_tree.warnings(games.read_json_files(spark, a.game)).limit(20).collect():
        print(f"{r.file}: {r.warning}", file=sys.stderr)
    return 0


def translate(spark: SparkSession, a: argparse.Namespace) -> int:
    e = numbered(csv_store.read_entries(spark, a.texts))
    old = numbered(csv_store.read_results(spark, a.resume)) if a.resume else None
    memory = csv_store.read_memory(spark, a.memory) if a.memory else None
    terms = csv_store.read_glossary(spark, a.glossary) if a.glossary else None
    names = csv_store.read_namebox(spark, a.names) if a.names else None
    size = a.batch_size or auto_batch_size(e).first().batch_size  # 0: by the length of the texts
    rules = csv_store.read_rules(spark, a.corrections) if a.corrections else []
    options = Options(a.target, a.source, a.provider, size, corrections=rules, restart=a.restart, auto_glossary=True)
    if names is not None:
        names = translate_names(e, options, names)
        csv_store.write_namebox(names, a.names + ".new")
    out = run(e, options, old, memory, names, terms)
    csv_store.write_results(out.drop("origin"), a.out)
    return 0


def apply(spark: SparkSession, a: argparse.Namespace) -> int:
    files = games.read_json_files(spark, a.game).unionByName(games.read_scripts(spark, a.game))
    made = numbered(csv_store.read_results(spark, a.results))
    used = files.join(made.select("file").distinct(), "file", "left_semi")
    double = games.duplicate_outputs(used, games.output_path(F.col("file"))).limit(1).collect()
    if double:
        raise SystemExit(f"several files would be written to {double[0].output}")
    patched = store(games.patch(files, made), "patched")
    if patched.where("applied = 0 and stale > 0").limit(1).count():
        raise SystemExit("no path of some file is there any more: nothing is written")
    games.write_files(patched.where("body is not null").select(games.output_path(F.col("file")).alias("output"), "body"), a.out)
    return 0


def auto(spark: SparkSession, a: argparse.Namespace) -> int:
    """Everything from the game to its patched files, with the texts and results beside them."""
    a.texts, a.results = f"{a.out}/texts", f"{a.out}/results"
    where, a.out = a.out, a.texts
    extract(spark, a)
    a.out = a.results
    translate(spark, a)
    a.out = f"{where}/patched"
    return apply(spark, a)


def pipeline(spark: SparkSession, a: argparse.Namespace) -> int:
    """From the game to its results, without patching."""
    a.texts = f"{a.out}/texts"
    where, a.out = a.out, a.texts
    extract(spark, a)
    a.out = f"{where}/results"
    return translate(spark, a)


def diff(spark: SparkSession, a: argparse.Namespace) -> int:
    old, new = (results.dedupe_last(numbered(csv_store.read_entries(spark, p))) for p in (a.old, a.new))
    tr = results.dedupe_last(numbered(csv_store.read_results(spark, a.translations)).drop("extra"))
    out = results.diff(old, new, tr)
    out.write.mode("overwrite").options(**csv_store.WRITE).csv(a.out)
    print(json.dumps({r.s: r["count"] for r in out.groupBy(F.substring_index("status", " ", 1).alias("s")).count().collect()}))
    return 0


def retry(spark: SparkSession, a: argparse.Namespace) -> int:
    csv_store.write_results(results.cleared(csv_store.read_results(spark, a.results), a.filter), a.out)
    return 0


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    r = numbered(csv_store.read_results(spark, a.results))
    report = results.validation_report(r).first().asDict()
    report["warnings"] = {x.warning: x.rows for x in results.warning_counts(r).collect()}
    report["nouns"] = [x.message for x in results.noun_messages(r).collect()]
    if a.glossary:
        report["glossary"] = [x.warning for x in glossary.lint(csv_store.read_glossary(spark, a.glossary)).orderBy("line_no").collect()]
    print(json.dumps(report, ensure_ascii=False, indent=1))
    doubtful = report["warnings"] or report["nouns"] or report["fallback"] or report["empty"] or report.get("glossary")
    return 1 if not report["total"] else 2 if a.strict and doubtful else 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lingoweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    asks = ["--target", "--source=auto", "--provider=upper", "--batch-size=0", "--resume=", "--memory=", "--corrections=", "--glossary=", "--names=", "--restart!"]
    specs = {
        scan: ["game"], extract: ["game", "out"], translate: ["texts", "out", *asks], pipeline: ["game", "out", *asks], auto: ["game", "out", *asks],
        apply: ["game", "results", "out"], diff: ["old", "new", "--translations", "out"], retry: ["results", "out", "--filter=needs-retry"], validate: ["results", "--glossary=", "--strict!"],
    }
    for f, names in specs.items():
        q = sub.add_parser(f.__name__)
        q.set_defaults(run=f)
        for n in names:
            if n.endswith("!"):
                q.add_argument(n[:-1], action="store_true")
            elif "=" in n:
                name, default = n.split("=")
                q.add_argument(name, default=int(default) if default.isdigit() else default)
            else:
                q.add_argument(n, **({"required": True} if n.startswith("--") else {}))
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"lingoweave {a.command}").getOrCreate()
    ship(spark)
    return a.run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
