"""python -m tidemill evaluate --out DIR | demo --out DIR"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .config import fingerprint, load
from .plans import demo, runner
from .plans.artifacts import write_once
from .sources import generator


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemill", description=__doc__)
    p.add_argument("what", choices=["evaluate", "demo"])
    p.add_argument("--out", required=True)
    p.add_argument("--config")
    p.add_argument("--table", default="dev")
    a = p.parse_args(args)
    cfg = load(a.config)
    spark = SparkSession.builder.appName("tidemill").getOrCreate()
    if a.what == "demo":
        print(demo.seed(spark, a.out, cfg=cfg))
        return 0
    write_once(f"{a.out}/pre_run.json", {"table": a.table, "config": fingerprint(cfg), "spark": spark.version, "python": sys.version})
    try:
        data = generator.generate(spark, a.table, cfg)
        data["readings"] = data["readings"].cache()
        frames = runner.dataset_features(data, cfg).cache()
        selection, fitted = runner.select(data, frames, cfg)
        write_once(f"{a.out}/selection.json", selection)  # before any test row is scored
        test = runner.score_test(selection, fitted, data, frames, cfg)
        write_once(f"{a.out}/evaluation.json", {"selection": selection["identity"], "test": {k: [r.asDict() for r in d.collect()] for k, d in test.items()}})
    except Exception as e:
        write_once(f"{a.out}/failure.json", {"error": f"{type(e).__name__}: {e}"})
        raise
    return 0


if __name__ == "__main__":
    sys.exit(main())
