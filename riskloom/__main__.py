"""Commands: python -m riskloom discover | features | splits | search | stack | train. Tables are Parquet or CSV (by their ending) wherever Spark can read them."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULTS
from .operators import splits
from .plans import boosting, models, networks, pipelines, store
from .sources import readers, sinks


def read(spark: SparkSession, path: str) -> DataFrame:
    return readers.csv(spark, path) if path.rstrip("/").endswith(".csv") else readers.parquet(spark, path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="riskloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *required: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about, description=about)
        for r in (*required, "--out"):
            c.add_argument(r, required=True)
        c.add_argument("--seed", type=int, default=DEFAULTS.seed)
        return c

    c = command("discover", "Finds outcome-like columns and composes labels and a risk score.", "--data", "--dictionary")
    c.add_argument("--catalog")
    c.add_argument("--outcome-score", type=float, default=DEFAULTS.outcome_score)
    c.add_argument("--event-quantile", type=float, default=DEFAULTS.event_quantile)
    c.add_argument("--compat", action="store_true", help="read windows as the first version did")
    c = command("features", "Guards, fills, transforms, scales, prunes and audits features.", "--data", "--dictionary", "--labels")
    c.add_argument("--label", default=None, help="the label's column; else the preferred one")
    c.add_argument("--fill-rate", type=float, default=DEFAULTS.fill_rate)
    c.add_argument("--correlation", type=float, default=DEFAULTS.correlation_inclusive)
    c = command("splits", "Deals rows to train, val and test, by class.", "--matrix")
    for part, share in (("train", 0.70), ("val", 0.15), ("test", 0.15)):
        c.add_argument(f"--{part}", type=float, default=share)
    c = command("search", "Searches parameters of boosted trees by out-of-fold metrics.", "--matrix")
    c.add_argument("--trials", type=int, default=60)
    c.add_argument("--folds", type=int, default=5)
    c.add_argument("--rounds", type=int, nargs=2, default=(800, 2000))
    c.add_argument("--patience", type=int, default=200)
    c = command("stack", "Stacks out-of-fold trees and a perceptron, calibrates and reports.", "--matrix")
    c.add_argument("--trials", help="a table that search wrote; its best parameters are used")
    c.add_argument("--folds", type=int, default=5)
    c.add_argument("--rounds", type=int, default=None)
    c.add_argument("--epochs", type=int, default=30)
    c.add_argument("--nested", action="store_true")
    c = command("train", "Fits boosted trees or a network by folds, with early stopping; writes scores, a report and the models.", "--matrix")
    c.add_argument("--model", choices=["trees", "perceptron", "attention"], default="trees")
    c.add_argument("--folds", type=int, default=5)
    c.add_argument("--rounds", type=int, default=500, help="trees, or epochs of a network")
    c.add_argument("--rate", type=float, default=None)
    c.add_argument("--patience", type=int, default=20)
    c.add_argument("--monotone", help="a JSON object: 1 or -1 for features whose effect must rise or fall")
    return p


def _matrix(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    t = read(spark, path)
    return t, [c for c in t.columns if c not in ("row_id", "y", "fold", "split")]


def run(spark: SparkSession, argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    out = a.out.rstrip("/")
    if a.command == "discover":
        df = read(spark, a.data)
        words = readers.dictionary(read(spark, a.dictionary), "exact")
        words = readers.merge_catalog(words, read(spark, a.catalog)) if a.catalog else words
        meta = words.select(F.col("variable").alias("column_name"), "description")
        settings = replace(DEFAULTS, seed=a.seed, outcome_score=a.outcome_score, event_quantile=a.event_quantile)
        numeric, _ = pipelines.profile.by_type(df, [c for c in df.columns if c != "row_id"])
        found = pipelines.discover_labels(df, numeric, meta, settings, a.compat)
        sinks.write_parquet(found.candidates, f"{out}/candidates")
        sinks.write_parquet(found.negative, f"{out}/negative_patterns")
        if found.labels is None:
            raise SystemExit("no column makes a label")
        sinks.write_parquet(found.labels, f"{out}/labels")
        sinks.write_lines(spark.createDataFrame([(x,) for x in found.sources], "source string"), "source", f"{out}/sources")
    elif a.command == "features":
        labels = read(spark, a.labels)
        label = a.label or readers.preferred_label(labels.columns)
        df = read(spark, a.data).join(labels.select("row_id", F.col(label).cast("int").alias("y")), "row_id")
        meta = readers.dictionary(read(spark, a.dictionary), "exact").select(F.col("variable").alias("column_name"), "description")
        settings = replace(DEFAULTS, seed=a.seed, fill_rate=a.fill_rate, correlation_inclusive=a.correlation)
        made = pipelines.engineer_features(df, [c for c in df.columns if c not in ("row_id", "y")], meta, s=settings)
        sinks.write_parquet(made.matrix, f"{out}/matrix")
        sinks.write_parquet(made.audit, f"{out}/audit")
        sinks.write_parquet(made.guard, f"{out}/guard")
    elif a.command == "splits":
        t, _ = _matrix(spark, a.matrix)
        parts = splits.stratified_split(t.select("row_id", "y"), {"train": a.train, "val": a.val, "test": a.test}, a.seed)
        sinks.write_parquet(parts.select("row_id", "split"), out)
    elif a.command == "search":
        t, features = _matrix(spark, a.matrix)
        sinks.write_parquet(models.search(t, features, a.trials, a.folds, tuple(a.rounds), a.patience, seed=a.seed), out)
    elif a.command == "stack":
        t, features = _matrix(spark, a.matrix)
        trees = models.best_parameters(read(spark, a.trials)) if a.trials else models.for_stacking()
        trees = replace(trees, rounds=a.rounds) if a.rounds else trees
        made = pipelines.train(t, features, a.folds, replace(DEFAULTS, seed=a.seed), a.nested, trees, t=networks.Training(epochs=a.epochs, block=256, seed=a.seed))
        for name, table in made.items():
            sinks.write_parquet(table, f"{out}/{name}")
    else:
        t, features = _matrix(spark, a.matrix)
        t = splits.stratified_folds(t.select("row_id", "y", *features), a.folds, a.seed)
        rising = dict(zip(features, readers.monotone(a.monotone, features))) if a.monotone else {}
        if a.model == "trees":
            model, scores = boosting.cross_validated(t, features, boosting.Parameters(rounds=a.rounds, rate=a.rate or 0.05, patience=a.patience, rising=rising, seed=a.seed), a.folds)
            sinks.write_parquet(spark.createDataFrame(boosting.importance(model), "feature string, importance double"), f"{out}/importance")
        else:
            net = networks.Perceptron(len(features)) if a.model == "perceptron" else networks.Attention(len(features))
            fitted, scores = networks.cross_validated(t, features, net, networks.Training(epochs=a.rounds, rate=a.rate or 1e-3, patience=a.patience, seed=a.seed), a.folds)
            model = [net, fitted]
        store.save(spark, model, f"{out}/model")
        sinks.write_parquet(scores, f"{out}/scores")
        sinks.write_parquet(models.fold_report(scores), f"{out}/report")


def main() -> None:
    spark = SparkSession.builder.appName("riskloom").getOrCreate()
    try:
        run(spark)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
