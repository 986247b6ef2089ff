"""Boosted-tree classifiers and horizon forecasters as Spark ML jobs, and their bundles."""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gauge_engine.columns import HISTORY_DAYS, HORIZON_DAYS, STATIONS, THRESHOLD_STDS, SensorColumns
from gauge_engine.functions.scalars import class_weight
from gauge_engine.operators.logs import best_iteration, early_stop
from gauge_engine.operators.metrics import class_balance
from gauge_engine.session import ensure_checkpoints, materialize


@dataclass(frozen=True)
class BoostingSettings:
    """Defaults: depth 4, rate 0.05, 400 rounds, 80 % of rows and features per step."""

    depth: int = 4
    rate: float = 0.05
    rounds: int = 400
    row_share: float = 0.8
    feature_share: float = 0.8
    seed: int = 42


# A round is a handful of small jobs. Few rows in many tasks cost more than they save, so rows are
# dealt to tasks by their number; a task's partial sums are what it sends.
ROWS_PER_TASK = 50_000
# Rounds between two cuts of the lineage.
CHECKPOINT_ROUNDS = 25
# Histograms of the nodes that one pass splits, per task.
NODE_MEMORY_MB = 512
# Margins that a task counts at once, and rows of a round that a task sorts, about.
MARGINS_AT_ONCE, SORTED_ROWS = 1 << 21, 250_000

# The settings of the variant that chooses its rounds on a validation split.
VALIDATED_SETTINGS = BoostingSettings(depth=6, rounds=600, row_share=1.0, feature_share=1.0)


def _prepared(windows: DataFrame, label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Vector features, double labels and balancing weights."""
    weight = class_balance(windows.select(label), label).select("weight").scalar()
    return windows.select(
        array_to_vector("x").alias("features"),
        F.col(label).cast("double").alias("label"),
        class_weight(label, weight).alias("weight"),
        *keep,
    )


def fitting_tasks(rows: int) -> int:
    """How many tasks a fit over so many rows takes."""
    return max(1, -(-rows // ROWS_PER_TASK))


@contextmanager
def _held(rows: DataFrame, each: str | None = None) -> Iterator[DataFrame]:
    """Keep rows, dealt to as many tasks as their number asks for, while a fit passes over them.

    ``each`` names an array column of whose elements the fit makes a row apiece: these are
    counted then. Rows are written once, so that lost executors cost a read and not the
    series again.
    """
    written = materialize(rows, "fit-rows")
    passed = F.sum(F.array_size(each)) if each else F.count(F.lit(1))
    number = written.agg(F.coalesce(passed, F.lit(0))).first()[0]
    held = written.repartition(fitting_tasks(number)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def _fit(rows: DataFrame, settings: BoostingSettings, label: str) -> GBTClassificationModel:
    ensure_checkpoints(rows.sparkSession)
    learner = GBTClassifier(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        maxDepth=settings.depth,
        stepSize=settings.rate,
        maxIter=settings.rounds,
        subsamplingRate=settings.row_share,
        featureSubsetStrategy=str(settings.feature_share),
        seed=settings.seed,
        checkpointInterval=CHECKPOINT_ROUNDS,
        maxMemoryInMB=NODE_MEMORY_MB,
    )
    return learner.fit(_prepared(rows, label))


def fit_boosting(
    windows: DataFrame,
    settings: BoostingSettings = BoostingSettings(),
    label: str = "y",
) -> GBTClassificationModel:
    """Class-weighted boosted trees on flat blocks."""
    with _held(windows.select("x", label)) as rows:
        return _fit(rows, settings, label)


def round_metrics(model: GBTClassificationModel, windows: DataFrame, label: str = "y") -> DataFrame:
    """A metric log ``iter, AUC, Logloss``: the model cut after each round, on all rows.

    Every tree's leaf is looked up once per row; running sums give the margins of all
    rounds. AUC is 0.5 where a class is missing.
    """
    values = [
        weight * np.array([float(v) for v in re.findall(r"Predict: (\S+)", tree.toDebugString)])
        for weight, tree in zip(model.treeWeights, model.trees)
    ]

    # One table of leaf values, tree after tree; a batch of leaves is one look-up in it.
    first_leaf = np.cumsum([0, *[len(v) for v in values[:-1]]])
    leaf_values = np.concatenate(values)
    # Margins of a round are cut into parts of equal width between the least and the largest possible.
    low = np.cumsum([v.min() for v in values])
    width = np.cumsum([v.max() for v in values]) - low
    rounds, parts = len(values), 1 + windows.count() // SORTED_ROWS
    step = max(1, MARGINS_AT_ONCE // rounds)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per round and part the different margins of some rows, and the classes at each."""
        for frame in frames:
            for start in range(0, len(frame), step):
                leaves = np.stack(frame["_leaves"].iloc[start : start + step].to_list()).astype("int64") + first_leaf
                event = frame["_event"].iloc[start : start + step].to_numpy(dtype=bool)
                margins = np.cumsum(leaf_values[leaves], axis=1)
                # The margin is half the log odds.
                losses = np.logaddexp(0, np.where(event, -2.0, 2.0)[:, None] * margins).sum(axis=0)
                out = []
                for i in range(rounds):
                    level, at = np.unique(margins[:, i], return_inverse=True)
                    pos = np.bincount(at, weights=event).astype("<i4")
                    neg = np.bincount(at, weights=~event).astype("<i4")
                    part = np.clip((level - low[i]) / (width[i] or 1.0) * parts, 0, parts - 1).astype(int)
                    edges = np.flatnonzero(np.diff(part, prepend=-1))
                    for a, b in zip(edges, [*edges[1:], len(level)]):
                        held = (level[a:b].tobytes(), pos[a:b].tobytes(), neg[a:b].tobytes())
                        out.append((i, part[a], *held, losses[i] if a == 0 else 0.0))
                yield pd.DataFrame(out, columns=["iter", "part", "levels", "pos", "neg", "loss"])

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        """Classes of a part of a round, its loss, and the pairs of it that are in order."""
        level, pos, neg = (
            np.concatenate([np.frombuffer(v, kind) for v in frame[name]])
            for name, kind in (("levels", "f8"), ("pos", "<i4"), ("neg", "<i4"))
        )
        order = np.argsort(level, kind="stable")
        starts = np.flatnonzero(np.diff(level[order], prepend=np.nan) != 0)
        pos, neg = (np.add.reduceat(v[order].astype("i8"), starts) for v in (pos, neg))
        wins = (pos * (np.cumsum(neg) - neg / 2.0)).sum()
        row = (frame["iter"].iloc[0], frame["part"].iloc[0], pos.sum(), neg.sum(), wins, math.fsum(frame["loss"]))
        return pd.DataFrame([row], columns=["iter", "part", "pos", "neg", "wins", "loss"])

    event = F.coalesce(F.col(label) == 1, F.lit(False)).alias("_event")
    rows = windows.select(array_to_vector("x").alias("features"), event)
    scored = model.copy().setLeafCol("_leaves").transform(rows).select(vector_to_array("_leaves").alias("_leaves"), "_event")
    pieces = scored.mapInPandas(counted, "iter int, part int, levels binary, pos binary, neg binary, loss double")
    summed = pieces.groupBy("iter", "part").applyInPandas(
        merged, "iter int, part int, pos bigint, neg bigint, wins double, loss double"
    )
    below = Window.partitionBy("iter").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = summed.withColumn("_below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    pos, neg = F.sum("pos"), F.sum("neg")
    wins = F.sum(F.col("wins") + F.col("pos") * F.col("_below"))
    return placed.groupBy("iter").agg(
        F.when(pos * neg == 0, 0.5).otherwise(wins / F.nullif(pos * neg, F.lit(0))).alias("AUC"),
        (F.sum("loss") / (pos + neg)).alias("Logloss"),
    )


def chosen_rounds(log: DataFrame, metric: str = "AUC", patience: int | None = None) -> int:
    """How many rounds a metric log speaks for: the best of all, the earliest on ties.

    With ``patience``, the best up to the round at which waiting that long would have ended.
    """
    larger = metric == "AUC"
    one_run = log.withColumn("_run", F.lit(0))
    if patience is None:
        best = best_iteration(one_run, "_run", metric=metric, larger_is_better=larger)
    else:
        best = early_stop(one_run, "_run", metric=metric, patience=patience, larger_is_better=larger)
    return int(best.first()["best_iter"]) + 1


@dataclass
class ValidatedFit:
    """A model refitted on all rows, the rounds chosen for it and the log they come from."""

    model: GBTClassificationModel
    rounds: int
    log: DataFrame


def validated_fit(
    windows: DataFrame,
    validation: str,
    settings: BoostingSettings = VALIDATED_SETTINGS,
    label: str = "y",
    metric: str = "AUC",
    patience: int | None = None,
    use_best_rounds: bool = True,
) -> ValidatedFit:
    """All rounds on the training part, every round scored on the held-out part, then a refit
    on all rows with the chosen rounds (or all of them)."""
    with _held(windows.select("x", label, validation)) as rows:
        first = _fit(rows.where(~F.col(validation)), settings, label)
        log = materialize(round_metrics(first, rows.where(validation), label), "metric-log")
        rounds = chosen_rounds(log, metric, patience)
        refit = replace(settings, rounds=rounds) if use_best_rounds else settings
        return ValidatedFit(_fit(rows, refit, label), rounds, log)


def fit_then_refit(
    windows: DataFrame,
    validation: str,
    settings: BoostingSettings = BoostingSettings(),
    label: str = "y",
    use_best_rounds: bool = True,
) -> GBTClassificationModel:
    """The model of ``validated_fit``; ``use_best_rounds=False`` refits with all rounds."""
    return validated_fit(windows, validation, settings, label, use_best_rounds=use_best_rounds).model


def score_windows(model: GBTClassificationModel, windows: DataFrame, out: str = "y_prob") -> DataFrame:
    """Probability of an event per window."""
    scored = model.transform(windows.withColumn("features", array_to_vector("x")))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def _with_day(block: str, day: str) -> F.Column:
    return F.concat(F.col(block), F.array(F.col(day).cast("double")))


def fit_horizon(
    windows: DataFrame, settings: BoostingSettings = BoostingSettings(), labels: str = "y_days"
) -> GBTClassificationModel:
    """One model for all horizon days, with the day as a further feature.

    The windows are kept, not their copies per day.
    """
    with _held(windows.select("x", labels), each=labels) as rows:
        per_day = rows.select("x", F.posexplode(labels).alias("_day", "_event"))
        return _fit(per_day.select(_with_day("x", "_day").alias("x"), "_event"), settings, "_event")


def score_horizon(
    model: GBTClassificationModel,
    windows: DataFrame,
    cols: SensorColumns = STATIONS,
    horizon: int = HORIZON_DAYS,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """A vector of daily probabilities per window, in horizon order.

    ``keys`` name a window; by default its entity and dates.

    The regrouping by window key needs no shuffle: the exploded rows keep the entity
    partitioning of the windows.
    """
    keys = list(keys or (cols.entity, "hist_start", "future_start"))
    days = F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))
    per_day = windows.select(*keys, "x", days.alias("_day")).withColumn("x", _with_day("x", "_day"))
    scored = score_windows(model, per_day, "_prob")
    ordered = F.sort_array(F.collect_list(F.struct("_day", "_prob")))
    return scored.groupBy(*keys).agg(F.transform(ordered, lambda d: d["_prob"]).alias("probs"))


_PUBLISHED = "written timestamp, about string, attempt string"


@dataclass
class ModelBundle:
    """A fitted model with everything needed to apply it again.

    The bundle of a user's scorer has no model of its own: it keeps the scaler, thresholds,
    features and sizes that the training part gave.
    """

    model: GBTClassificationModel | None
    features: Sequence[str]
    settings: BoostingSettings = field(default_factory=BoostingSettings)
    # What the model answers ("window" or "horizon"), or "scorer", and how its labels were made.
    kind: str = "window"
    stds: float = THRESHOLD_STDS
    basis: str = "raw"
    history: int = HISTORY_DAYS
    horizon: int = HORIZON_DAYS
    # How the number of rounds was chosen, if it was ("stratified AUC", ...), and a checksum of the
    # readings behind the fit.
    validation: str = ""
    trained_on: str = ""
    thresholds: DataFrame | None = None
    scaler: DataFrame | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        """Write model and tables under an attempt's name, then publish it by one row.

        The row is a file in a folder of its own, so fits that save at once do not meet.
        Readers take the last row and see whole bundles only, also while one is written.
        Earlier attempts stay for those who still read them.
        """
        name = uuid.uuid4().hex
        attempt = f"{path}/attempts/{name}"
        if self.model is not None:
            self.model.write().save(f"{attempt}/model")
        for part in ("thresholds", "scaler"):
            table = getattr(self, part)
            if table is not None:
                table.write.parquet(f"{attempt}/{part}")
        about = {
            "features": list(self.features),
            "settings": asdict(self.settings),
            "kind": self.kind,
            "stds": self.stds,
            "basis": self.basis,
            "history": self.history,
            "horizon": self.horizon,
            "validation": self.validation,
            "trained_on": self.trained_on,
            "tables": [n for n in ("thresholds", "scaler") if getattr(self, n) is not None],
        }
        row = spark.range(1).select(F.current_timestamp().alias("written"), F.lit(json.dumps(about)).alias("about"))
        row.coalesce(1).write.parquet(f"{path}/published/attempt={name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ModelBundle | None:
        """The bundle published last; None where there is none."""
        try:
            rows = spark.read.schema(_PUBLISHED).parquet(f"{path}/published")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        last = rows.orderBy(F.desc("written"), F.desc("attempt")).first()
        if last is None:
            return None
        about = json.loads(last["about"])
        attempt = f"{path}/attempts/{last['attempt']}"
        tables = {name: spark.read.parquet(f"{attempt}/{name}") for name in about.pop("tables")}
        about["settings"] = BoostingSettings(**about["settings"])
        model = None if about["kind"] == "scorer" else GBTClassificationModel.load(f"{attempt}/model")
        return cls(model=model, **about, **tables)


def fingerprint(readings: DataFrame, *columns: str) -> str:
    """A checksum of the rows that no order or partitioning changes; repeated rows count."""
    sums = readings.select(F.xxhash64(*columns).alias("_a"), F.xxhash64(F.lit(1), *columns).alias("_b")).agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.col("_a").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.bit_xor("_b"), F.lit(0))
    )
    return "-".join(str(v) for v in sums.first())


def load_or_fit(
    spark: SparkSession, path: str, fit: Callable[[], ModelBundle], **expected: object
) -> ModelBundle:
    """Reuse a complete bundle at ``path``; otherwise fit one and save it there.

    A bundle that differs in a field named in ``expected`` is refused.
    """
    found = ModelBundle.load(spark, path)
    if found is None:
        fit().save(spark, path)
        found = ModelBundle.load(spark, path)
    for name, want in expected.items():
        has = getattr(found, name)
        if (list(has) if name == "features" else has) != (list(want) if name == "features" else want):
            raise ValueError(f"the bundle at {path} has {name} {has}, not {want}")
    return found
