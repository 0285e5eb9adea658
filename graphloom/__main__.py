"""Command line: JSON lines on standard output.

    python -m graphloom queries
    python -m graphloom run resolution_counts --data /root/testdata/sf0.01
    python -m graphloom search "t:prefab ring" --data /root/testdata/sf0.01 --limit 5
    python -m graphloom suggest Assets/ --data /root/testdata/sf0.01
    python -m graphloom references object:nation:2 --data /root/testdata/sf0.01 --after "" --limit 20
    python -m graphloom inspect scenes|references|members|objects|pointers|bundles PATH
    python -m graphloom capabilities
    python -m graphloom validate PLAN.json|PLAN.yaml
    python -m graphloom export SCENES OUT --class-id 1 --name player --limit 10
    python -m graphloom recover FOLDER
"""

from __future__ import annotations

import argparse
import json
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from graphloom import queries, service
from graphloom.operators import changes, extraction, mutation, resolution, search
from graphloom.session import ready
from graphloom.sources import containers, scenes

INSPECT = {"scenes": scenes.scan_objects, "references": scenes.scan_references, "members": containers.scan_members, "objects": containers.scan_objects, "pointers": containers.scan_pointers, "bundles": containers.list_bundles}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="graphloom")
    sub = out.add_subparsers(dest="command", required=True)
    sub.add_parser("queries")
    sub.add_parser("capabilities")
    sub.add_parser("validate").add_argument("plan")
    sub.add_parser("recover").add_argument("folder")
    own = sub.add_parser("export")
    own.add_argument("scenes")
    own.add_argument("out")
    own.add_argument("--class-id", type=int, action="append", default=[])
    own.add_argument("--name")
    own.add_argument("--limit", type=int)
    own.add_argument("--existing", choices=extraction.EXISTING, default="error")
    own.add_argument("--stop", action="store_true")
    for name in ("run", "search", "suggest", "references"):
        own = sub.add_parser(name)
        own.add_argument("what")
        own.add_argument("--data", required=True)
        own.add_argument("--limit", type=int, default=25)
        if name == "references":
            own.add_argument("--direction", choices=("in", "out"), default="in")
            own.add_argument("--after", default="")
    own = sub.add_parser("inspect")
    own.add_argument("what", choices=sorted(INSPECT))
    own.add_argument("path")
    own.add_argument("--pattern", default="*")
    return out


def _yaml(column: pa.Array) -> pa.Array:
    return pa.array([scenes.serialize(json.loads(x)).encode() for x in column.to_pylist()], pa.binary())


def export(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The manifest of one file for each document of the scene files that is chosen."""
    rows = scenes.scan_objects(spark, args.scenes).filter("error is null and class_id is not null")
    base = F.substring_index("source", "/", -1)
    body = F.concat(F.lit('{"'), F.col("class_name"), F.lit('": '), F.col("props"), F.lit("}"))
    objects = rows.select(F.concat_ws("#", base, F.col("file_id").cast("string")).alias("address"), base.alias("source"), "class_id", "class_name", "name", F.lit("yaml").alias("kind"), F.arrow_udf(_yaml, BinaryType())(body).alias("payload"))
    made = extraction.plan(objects.drop("payload"), extraction.Request(class_ids=args.class_id, name_contains=args.name, limit=args.limit))
    there = spark.createDataFrame([], "path string, digest string")
    decided = extraction.decide(made, made.limit(0).withColumn("digest", F.lit("")), there, args.existing)
    return extraction.execute(decided, objects.select("address", "payload"), args.out, "stop_in_plan_order" if args.stop else "collect_all").orderBy("ordinal")


def result(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.command == "run":
        return queries.QUERIES[args.what](spark, args.data).limit(args.limit)
    if args.command == "export":
        return export(spark, args)
    if args.command == "recover":
        gone = changes.Generations(spark, args.folder).recover()
        return spark.createDataFrame([(x,) for x in gone], "removed string")
    if args.command == "inspect":
        return INSPECT[args.what](spark, args.path, args.pattern)
    if args.command == "references":
        return resolution.reference_page(resolution.dependency_keys(queries.resolved(spark, args.data)), args.what, args.direction, args.after, args.limit)
    table = queries.search_table(spark, args.data)
    return search.search(table, args.what, args.limit) if args.command == "search" else search.suggest_paths(table, args.what, args.limit)


def main(argv: list[str]) -> int:
    args = parser().parse_args(argv)
    if args.command == "queries":
        print(*sorted(queries.QUERIES), sep="\n")
        return 0
    if args.command == "capabilities":
        print(json.dumps({"operations": service.OPERATIONS, "capabilities": service.CAPABILITIES, "mutations": service.MUTATIONS, "errors": service.ERRORS}))
        return 0
    if args.command == "validate":
        with open(args.plan, encoding="utf-8") as f:
            raw = f.read()
        try:
            plan = (mutation.read_yaml if args.plan.endswith((".yaml", ".yml")) else mutation.read_json)(raw)
        except ValueError as e:
            print(json.dumps({"valid": False, "problem": str(e)}))
            return 1
        print(json.dumps({"valid": True, "operations": len(plan.operations), "digest": plan.digest()}))
        return 0
    if args.command == "run" and args.what not in queries.QUERIES:
        print(f"no query {args.what}", file=sys.stderr)
        return 2
    spark = ready(SparkSession.builder.appName("graphloom").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    for line in result(spark, args).toJSON().toLocalIterator():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
