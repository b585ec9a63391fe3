"""Command line: ``python -m brinkline enrich|stage1|stage2|figures``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .config import Settings
from .operators import forest
from .plans import enrich, stages
from .sources import tasks


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="brinkline")
    parser.add_argument("command", choices=("enrich", "stage1", "stage2", "figures"))
    parser.add_argument("--input", required=True)
    parser.add_argument("--output")
    parser.add_argument("--model")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("brinkline").getOrCreate()
    if args.command == "enrich":
        enrich.run(spark, args.input, args.output)
    elif args.command == "stage1":
        try:
            out = stages.stage1(spark, args.input, args.model)
        except ValueError as error:
            print(error, file=sys.stderr)
            return 1
        out.scores.show()
        out.importances.show()
    else:
        df = forest.predict(forest.load(args.model), tasks.load_stage2(spark, args.input), list(Settings().instruments))
        if args.command == "stage2":
            print(stages.stage2(df, summary_path=args.output)["facts"])
        else:
            for name, frame in stages.figures(df).items():
                frame.write.mode("overwrite").parquet(f"{args.output}/{name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
