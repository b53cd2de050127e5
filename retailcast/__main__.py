"""Run stages: python -m retailcast STAGE... --raw DIR --processed DIR --outputs DIR --test FROM TO"""

from __future__ import annotations

import argparse
import datetime as dt

from retailcast.operators import backtest, models
from retailcast.plans.stages import STAGES, Job
from retailcast.session import build_session, clear_scratch

_SIZES = ("forest_trees", "forest_depth", "forest_min_leaf", "boosting_rounds", "boosting_depth", "boosting_rate", "row_sample", "column_sample")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="retailcast")
    parser.add_argument("stages", nargs="+", choices=[*STAGES, "all"])
    parser.add_argument("--raw", required=True, help="folder with sales, features and stores")
    parser.add_argument("--raw-format", default="csv")
    parser.add_argument("--processed", required=True)
    parser.add_argument("--outputs", required=True)
    parser.add_argument("--test", nargs=2, required=True, type=dt.date.fromisoformat, metavar=("FROM", "TO"))
    parser.add_argument("--fits-at-once", type=int, default=1, help="folds or scenarios fitted side by side")
    parser.add_argument("--initial-train-weeks", type=int, default=backtest.INITIAL_TRAIN_WEEKS)
    parser.add_argument("--test-weeks", type=int, default=backtest.TEST_WEEKS, help="weeks of a fold")
    for name in _SIZES:
        default = getattr(models.Sizes(), name)
        parser.add_argument(f"--{name.replace('_', '-')}", type=type(default), default=default)
    every = models.Sizes().models
    parser.add_argument("--models", nargs="+", choices=every, default=every, help="models of the regression, sensitivity and coming-week stages")
    parser.add_argument("--reuse-models", action="store_true", help="forecast the coming week with the models of an earlier one")
    parser.add_argument("--master")
    given = parser.parse_args(arguments)
    job = Job(
        build_session(master=given.master),
        given.raw,
        given.processed,
        given.outputs,
        *given.test,
        raw_format=given.raw_format,
        fits_at_once=given.fits_at_once,
        reuse_models=given.reuse_models,
        initial_train_weeks=given.initial_train_weeks,
        test_weeks=given.test_weeks,
        sizes=models.Sizes(**{name: getattr(given, name) for name in _SIZES}, models=tuple(given.models)),
    )
    try:
        for name in STAGES if "all" in given.stages else given.stages:
            STAGES[name](job)
    finally:
        clear_scratch(job.spark)


if __name__ == "__main__":
    main()
