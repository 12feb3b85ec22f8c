"""Command line: ``python -m kindling <workflow|score|runs> ...`` (or via spark-submit).

workflow  clean -> EDA -> split -> fit -> score -> evaluate, written under --out/<stage>/run_id=<id>/
score     score detections (a folder or file; --stream for a file stream) with a saved model
runs      list run ids and saved models under a models folder, or the published runs of an --out folder
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kindling.schema import DETECTION_SCHEMA, FEATURES, FORM_RANGES
from kindling.session import ensure_checkpoint_dir


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("kindling").getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def _read(spark, path: str, fmt: str):
    from kindling.sources.readers import read_detections
    return read_detections(spark, path, DETECTION_SCHEMA if fmt == "csv" else None, fmt=fmt,
                           recursive=fmt == "csv")


def cmd_workflow(a) -> int:
    from kindling.plans.workflow import run_workflow, shipped_options
    spark = _session()
    opts = shipped_options(key_cols=a.key or [], test_size=a.test_size, seed=a.seed, eda=not a.no_eda)
    if a.region:
        opts.region = {"enabled": True}
    res = run_workflow(spark, _read(spark, a.input, a.format), opts, a.out, a.run_id, resume=a.resume)
    for r in res["scores"].collect():
        print(json.dumps({"run_id": res["run_id"], **r.asDict()}))
    return 0


def cmd_score(a) -> int:
    from kindling.models.specs import load_model
    from kindling.streaming.scoring import read_stream, score_frame, start_scoring
    spark = _session()
    model = load_model(a.model)
    if a.stream:
        from kindling.sources.readers import header_schema
        schema = header_schema(spark, a.input) if a.format == "csv" else \
            spark.read.format(a.format).load(a.input).schema
        scored = score_frame(read_stream(spark, a.input, schema, a.format), model, FEATURES, FORM_RANGES)
        q = start_scoring(scored, a.out, a.checkpoint, available_now=a.once)
        q.awaitTermination()
    else:
        scored = score_frame(_read(spark, a.input, a.format), model, FEATURES, FORM_RANGES)
        scored.write.mode("error").parquet(a.out)
        print(json.dumps({r.intensity or "invalid": r["count"] for r in scored.groupBy("intensity").count().collect()}))
    return 0


def cmd_runs(a) -> int:
    from kindling.sources.registry import list_runs, model_listing
    spark = _session()
    from kindling.sources.runlog import published_models
    listing = published_models(spark, a.out) if a.out else model_listing(spark, a.models)
    per_run = listing.groupBy("run_id").agg(F.sort_array(F.collect_set("model")).alias("models"))
    runs = list_runs(listing).join(per_run, "run_id").orderBy(F.col("run_id").desc())
    for r in runs.collect():  # one row per run
        print(json.dumps({"run_id": r.run_id, "models": list(r.models)}))
    return 0


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="kindling")
    sub = p.add_subparsers(dest="cmd", required=True)
    w = sub.add_parser("workflow", help="run the batch workflow")
    w.add_argument("--input", required=True)
    w.add_argument("--format", default="csv")
    w.add_argument("--out", required=True)
    w.add_argument("--key", nargs="*", help="unique key columns for the split")
    w.add_argument("--run-id", type=int)
    w.add_argument("--test-size", type=float, default=0.25)
    w.add_argument("--seed", type=int, default=1)
    w.add_argument("--region", action="store_true", help="keep the default bounding box only")
    w.add_argument("--no-eda", action="store_true")
    w.add_argument("--resume", action="store_true", help="take over the stages that an earlier start of --run-id finished")
    w.set_defaults(fn=cmd_workflow)
    s = sub.add_parser("score", help="score detections with a saved model")
    s.add_argument("--model", required=True)
    s.add_argument("--input", required=True)
    s.add_argument("--format", default="csv")
    s.add_argument("--out", required=True)
    s.add_argument("--stream", action="store_true")
    s.add_argument("--checkpoint", help="stream checkpoint folder (shared filesystem)")
    s.add_argument("--once", action="store_true", help="process what is there, then stop")
    s.set_defaults(fn=cmd_score)
    r = sub.add_parser("runs", help="list runs and their models")
    where = r.add_mutually_exclusive_group(required=True)
    where.add_argument("--models", help="folder holding run_id=<id>/<model>/, finished or not")
    where.add_argument("--out", help="a workflow's --out folder: published runs only")
    r.set_defaults(fn=cmd_runs)
    a = p.parse_args(argv)
    if a.cmd == "score" and a.stream and not a.checkpoint:
        p.error("--stream needs --checkpoint")
    return a.fn(a)


if __name__ == "__main__":
    sys.exit(main())
