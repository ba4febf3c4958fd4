"""python -m sunfold prepare|train|test|walk-forward: the jobs on station files."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import functions as F

from sunfold.operators import models
from sunfold.plans import pipeline
from sunfold.session import session
from sunfold.sources import files, sinks


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sunfold", description=__doc__)
    p.add_argument("job", choices=("prepare", "train", "test", "walk-forward"))
    p.add_argument("--input", nargs="*", default=[], help="station files")
    p.add_argument("--output", required=True, help="folder for tables and reports")
    p.add_argument("--config", help="JSON settings")
    p.add_argument("--force-rebuild", action="store_true", help="prepare again even if features are there")
    a = p.parse_args(argv)
    spark = session()
    config = pipeline.Config.load(a.config, os.environ) if a.config else pipeline.Config()

    def raw():
        df, failed = files.read_stations(spark, a.input)
        for path, why in failed.items():
            print(f"left out {path}: {why}")
        return df.withColumnRenamed("station", "series_id").withColumn("row_id", F.xxhash64("series_id", "ts"))

    if a.job == "walk-forward":
        got = pipeline.walk_forward(raw(), a.output, config)
        sinks.write_json(got, f"{a.output}/walk_forward")
        print(sinks.markdown_report(got, "Walk-forward"))
        return
    if a.force_rebuild or a.job == "prepare":
        features = pipeline.prepare(raw(), a.output, config)
    else:
        features = spark.read.parquet(f"{a.output}/features")
    if a.job in ("train", "test"):
        known = sinks.read_params(spark, f"{a.output}/params")
        if a.job == "train":
            _, got = pipeline.train(features, config, known, a.output)
        else:
            bank = models.load_bank(spark, f"{a.output}/models")
            sinks.write_predictions(pipeline.predictions(features, bank, config, "test", known), f"{a.output}/predictions")
            got = pipeline.test(features, bank, config, "test", known)
        sinks.write_json(got, f"{a.output}/{a.job}")
        print(sinks.markdown_report(got, a.job))


if __name__ == "__main__":
    main()
