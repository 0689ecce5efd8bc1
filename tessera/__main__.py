"""python -m tessera infer | validate: run inference on files, or check result files."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from tessera.operators.models import MODELS
from tessera.plans import resolve
from tessera.sources import files, tsv, validate


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    infer = commands.add_parser("infer", help="train on one folder of tables, infer on another")
    infer.add_argument("--train-dir", nargs="+", required=True, help="folder of the training tables; of several, the first that exists")
    infer.add_argument("--test-dir", nargs="+", required=True, help="folder of the test tables")
    infer.add_argument("--output-dir", required=True)
    infer.add_argument("--threshold-s2", type=float, default=0.78)
    infer.add_argument("--threshold-s3", type=float, default=0.78)
    infer.add_argument("--model-type", choices=MODELS, default="xgboost")
    infer.add_argument("--cap", type=int, default=8, help="candidates per entity")
    infer.add_argument("--without-tfidf", action="store_true")
    check = commands.add_parser("validate", help="check result files; exits with 1 if there are errors")
    check.add_argument("--matching", required=True)
    check.add_argument("--candidates")
    check.add_argument("--test-dir", nargs="+", required=True)
    check.add_argument("--skip-id-check", action="store_true", help="do not look targets up")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    own = parser().parse_args(args)
    logging.basicConfig(level=logging.INFO)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    test = files.first_existing(spark, *own.test_dir)
    tables = [f"{test}/test_source{k}.tsv" for k in (1, 2, 3)]
    if own.command == "infer":
        train = files.first_existing(spark, *own.train_dir)
        given = (*[f"{train}/train_source{k}.tsv" for k in (1, 2, 3)], f"{train}/train_ground_truth.tsv")
        resolve.run_inference(spark, given, tuple(tables), own.output_dir, own.model_type, own.cap, own.threshold_s2, own.threshold_s3, use_tfidf=not own.without_tfidf)
        return 0
    known = None if own.skip_id_check else tsv.read_ids(spark, tables[1]).union(tsv.read_ids(spark, tables[2]))
    report = validate.validate(spark, own.matching, own.candidates, tsv.read_ids(spark, tables[0]), known)
    for kind, found in (("error", report.errors), ("warning", report.warnings)):
        for line in found:
            print(f"{kind}: {line}")
    return report.exit_code


if __name__ == "__main__":
    raise SystemExit(main())
