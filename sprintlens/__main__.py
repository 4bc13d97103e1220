"""python -m sprintlens demo | init-config PATH | pipeline --config PATH [--stages A,B] [--again]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sprintlens", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    demo = sub.add_parser("demo", help="train on synthetic history and forecast a sprint")
    demo.add_argument("--seed", type=int, default=7)
    demo.add_argument("--work-inference", choices=("hmm", "hawkes", "state_space"), default="hmm")
    demo.add_argument("--predictor", choices=("mdn", "quantile", "multitask"), default="mdn")
    demo.add_argument("--no-syntax", action="store_true", help="token features only")
    init = sub.add_parser("init-config", help="write the default settings; refuses to overwrite")
    init.add_argument("path")
    pipe = sub.add_parser("pipeline", help="run stages")
    pipe.add_argument("--config", required=True)
    pipe.add_argument("--stages", default="mine,infer,train,forecast")
    pipe.add_argument("--again", action="store_true", help="run the stages even if they are done; authors without new commits keep their fits")
    a = p.parse_args(argv)
    if a.command == "init-config":
        from .plans.config import write_default

        write_default(a.path)
        return 0
    spark = SparkSession.builder.appName("sprintlens").getOrCreate()
    if a.command == "demo":
        from .plans.demo import run

        for row in run(spark, a.seed, a.work_inference, a.predictor, not a.no_syntax).toJSON().collect():
            print(row)
    else:
        from .plans.config import Config
        from .plans.stages import Pipeline

        print("ran:", *Pipeline(spark, Config.load(a.config)).run(tuple(a.stages.split(",")), a.again))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
