"""Command line: check what a run needs, replay captures into a folder, check a run's outputs, page through findings."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from . import preflight
from .config import Settings
from .operators import emit, health, report
from .plans.replay import replay


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="strandscope", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("replay", help="analyse capture files")
    run.add_argument("captures")
    run.add_argument("output")
    run.add_argument("--config")
    doctor = commands.add_parser("doctor", help="check settings, inputs and output without a run")
    doctor.add_argument("captures")
    doctor.add_argument("output")
    doctor.add_argument("--config")
    check = commands.add_parser("validate", help="compare findings with the manifest of their run")
    check.add_argument("output")
    show = commands.add_parser("report", help="print a page of findings")
    show.add_argument("output")
    show.add_argument("--detector")
    show.add_argument("--contains", default="")
    show.add_argument("--limit", type=int, default=50)
    return parser.parse_args(argv)


MANIFEST = "detector string, lines long, digest string"


def _manifest(findings):
    return emit.digest(findings.withColumn("detector_", F.col("detector")), ["detector_"], emit.json_line(findings), ["finding_id"]).withColumnRenamed("detector_", "detector")


def _problems(spark: SparkSession, captures: str, output: str) -> list[str]:
    try:
        short = [f"not_a_capture:{r['path']}" for r in preflight.unreadable(spark, captures).limit(20).collect()]
    except AnalysisException:
        short = [f"no_captures:{captures}"]
    return short + preflight.claim(output)


def main(argv: list[str] | None = None) -> int:
    """0: complete; 3: incomplete; 1: outputs don't agree with the manifest or aren't private; 2: configuration, inputs or output folder."""
    args = _arguments(argv)
    spark = SparkSession.builder.appName("strandscope").getOrCreate()
    if args.command in ("doctor", "replay"):
        try:
            settings = Settings.load(args.config) if args.config else Settings()
        except (OSError, ValueError) as problem:
            print(problem, file=sys.stderr)
            return 2
        problems = _problems(spark, args.captures, args.output)
        if problems or args.command == "doctor":
            print(json.dumps({"problems": problems}))
            return 2 if problems else 0
        run = replay(spark, args.captures, settings, f"{args.output}/scratch")
        emitted = Observation("emitted")
        run.findings.observe(emitted, F.count("*").alias("n")).write.mode("errorifexists").json(f"{args.output}/findings")
        findings = spark.read.schema(run.findings.schema).json(f"{args.output}/findings")
        _manifest(findings).write.mode("errorifexists").json(f"{args.output}/manifest")
        run.counters.write.mode("errorifexists").json(f"{args.output}/counters")
        sent = spark.createDataFrame([("findings", emitted.get["n"])], "what string, n long")
        written = findings.agg(F.lit("findings").alias("what"), F.count("*").alias("n"))
        differ = health.reconcile(sent, written, ["what"]).select(F.lit("findings_emitted_and_written_differ").alias("reason"))
        verdict = health.verdict(run.counters, run.reasons.unionByName(differ)).first()
        print(json.dumps({"verdict": verdict["verdict"], "reasons": verdict["reasons"]}))
        return 0 if verdict["verdict"] == "complete" else 3
    findings = spark.read.json(f"{args.output}/findings")
    if args.command == "validate":
        want = set(map(tuple, spark.read.schema(MANIFEST).json(f"{args.output}/manifest").collect()))
        got = set(map(tuple, _manifest(findings).select("detector", "lines", "digest").collect())) if findings.columns else set()
        problems = preflight.exposed(args.output)
        print(json.dumps({"valid": want == got and not problems, "problems": problems}))
        return 0 if want == got and not problems else 1
    if not findings.columns:
        return 0
    if args.detector:
        findings = findings.where(F.col("detector") == args.detector)
    if args.contains:
        findings = report.search(findings.withColumn("__line", F.to_json(F.struct("*"))), "__line", args.contains).drop("__line")
    for line in report.tail_page(findings, "observed_timestamp_ns", args.limit).toJSON().collect():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
