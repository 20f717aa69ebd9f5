"""Churn models on ``pyspark.ml``.

Fill values and scales are stages of the fitted pipeline: they come from the training rows only
and are stored with the model.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.functions import percent_bucket
from lapsewise.operators.evaluation import auc
from lapsewise.operators.prepare import input_stages
from lapsewise.operators.ranking import global_rank, settle
from lapsewise.session import freeze

LABEL = "churned"


def as_doubles(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``cols`` as doubles; those of text are categories and stay."""
    text = {c for c, kind in df.dtypes if kind == "string"}
    chosen = set(cols) - text
    return df.select(*[F.col(c).cast("double").alias(c) if c in chosen else F.col(c) for c in df.columns])


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Add the feature vector; a missing value is an error, so impute first."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(
        as_doubles(df, cols)
    )


def _input_stages(cols: Sequence[str], categories: Sequence[str] = (), clip: tuple[float, float] | None = None) -> list:
    if categories or clip is not None:
        return input_stages(cols, categories, clip)
    filled = [f"_filled_{c}" for c in cols]
    return [
        Imputer(inputCols=list(cols), outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=filled, outputCol="_raw", handleInvalid="error"),
    ]


def _logistic(weight: str | None, reg: float = 0.01) -> LogisticRegression:
    # Already scaled in the stage before.
    learner = LogisticRegression(
        featuresCol="_features", labelCol=LABEL, maxIter=50, regParam=reg, standardization=False
    )
    return learner.setWeightCol(weight) if weight else learner


def _gbt(seed: int, rounds: int, depth: int, weight: str | None) -> GBTClassifier:
    learner = GBTClassifier(featuresCol="_raw", labelCol=LABEL, seed=seed, maxIter=rounds, maxDepth=depth)
    return learner.setWeightCol(weight) if weight else learner


def fit_logistic(
    train: DataFrame,
    cols: Sequence[str],
    weight: str | None = None,
    categories: Sequence[str] = (),
    clip: tuple[float, float] | None = None,
    reg: float = 0.01,
    rounds: int = 50,
) -> PipelineModel:
    """Logistic baseline. With ``categories`` or ``clip`` (two quantiles) the features are prepared
    by ``prepare.input_stages``, whose statistics come from ``train`` and stay with the model."""
    scale = StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True)
    learner = _logistic(weight, reg).setMaxIter(rounds)
    if reg == 0:
        learner = learner.setTol(1e-12)
    return Pipeline(stages=[*_input_stages(cols, categories, clip), scale, learner]).fit(as_doubles(train, cols))


def fit_gbt(
    train: DataFrame,
    cols: Sequence[str],
    seed: int = 7,
    rounds: int = 20,
    depth: int = 4,
    weight: str | None = None,
    categories: Sequence[str] = (),
    clip: tuple[float, float] | None = None,
) -> PipelineModel:
    """Boosted trees: the role of the named library, not its numbers. ``categories`` and ``clip``
    as for ``fit_logistic``."""
    return Pipeline(stages=[*_input_stages(cols, categories, clip), _gbt(seed, rounds, depth, weight)]).fit(
        as_doubles(train, cols)
    )


def tune(
    train: DataFrame, cols: Sequence[str], regs: Sequence[float], folds: int = 3, salt: str = "fold"
) -> tuple[PipelineModel, DataFrame]:
    """Cross-validate the logistic penalty; folds follow a hash of the customer.

    Returns the refitted best model and ``reg, mean_auc, best``. ``search`` compares learners of
    any kind.
    """
    scale = StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True)
    learner = _logistic(None)
    data, _ = freeze(
        as_doubles(train, cols).withColumn("_fold", (percent_bucket("customer_id", salt) % folds).cast("int"))
    )
    search = CrossValidator(
        estimator=Pipeline(stages=[*_input_stages(cols), scale, learner]),
        estimatorParamMaps=ParamGridBuilder().addGrid(learner.regParam, list(regs)).build(),
        evaluator=BinaryClassificationEvaluator(labelCol=LABEL),
        numFolds=folds,
        foldCol="_fold",
        parallelism=2,
    )
    found = search.fit(data)
    top = max(found.avgMetrics)
    report = [(float(r), float(m), int(m == top)) for r, m in zip(regs, found.avgMetrics)]
    return found.bestModel, train.sparkSession.createDataFrame(
        report, "reg double, mean_auc double, best int"
    )


#: A candidate of a search: fits a pipeline on training rows.
Learner = Callable[[DataFrame], PipelineModel]


def search(
    train: DataFrame,
    learners: Mapping[str, Learner],
    path: str,
    cols: Sequence[str] = (),
    rungs: Sequence[int] = (25, 100),
    keep: float = 0.5,
    folds: int = 3,
    salt: str = "search",
) -> tuple[PipelineModel, DataFrame]:
    """Successive halving (Jamieson & Talwalkar 2016) over learners of any kind.

    Each rung takes a hashed percentage of the customers, every rung all of the one before, and
    cross-validates the learners that are left, scores taken to six digits; the best ``keep`` of them by mean fold AUC, ties
    by name, go on to the next. Folds are a second hash, so a customer is in one fold at all
    rungs. The scores of every held-out fold are stored at ``path`` (``rung, candidate, fold,
    customer_id, churned, probability``) and all measures come from there. Returns the winner of
    the last rung, fitted on all of ``train`` (``cols`` become doubles before), and ``rung, candidate, fold, rows, auc, kept``; a
    fold without both classes has no AUC and does not count.
    """
    fold = (percent_bucket("customer_id", f"{salt}:fold") % folds).cast("int")
    train = as_doubles(train, cols)
    data, _ = freeze(train.withColumn("_fold", fold).withColumn("_share", percent_bucket("customer_id", f"{salt}:rung")))
    left = sorted(learners)
    report: list[tuple] = []
    for rung, percent in enumerate(rungs):
        rows, _ = freeze(data.where(F.col("_share") < percent))
        for name in left:
            for k in range(folds):
                inner = rows.where(F.col("_fold") != k).drop("_fold", "_share")
                outer = rows.where(F.col("_fold") == k)
                if inner.select(LABEL).distinct().count() < 2:
                    continue
                scored = score(learners[name](inner), outer, ())
                # Scores that differ by rounding errors of a learner are ties.
                scored.select("customer_id", LABEL, F.round("probability", 6).alias("probability")).withColumns(
                    {"rung": F.lit(rung), "candidate": F.lit(name), "fold": F.lit(k)}
                ).write.mode("append").parquet(path)
        stored = train.sparkSession.read.parquet(path).where(F.col("rung") == rung)
        areas = auc(stored, by=["candidate", "fold"]).select("candidate", "fold", (F.col("positives") + F.col("negatives")).alias("rows"), "auc").collect()
        means = {n: _mean([r["auc"] for r in areas if r["candidate"] == n]) for n in left}
        ahead = sorted(left, key=lambda n: (-means[n], n))
        last = rung == len(rungs) - 1
        kept = ahead[: 1 if last else max(1, math.ceil(len(ahead) * keep))]
        report += [(rung, r["candidate"], r["fold"], r["rows"], r["auc"], int(r["candidate"] in kept)) for r in areas]
        left = sorted(kept)
    found = train.sparkSession.createDataFrame(report, "rung int, candidate string, fold int, rows bigint, auc double, kept int")
    return learners[left[0]](train), found


def _mean(values: Sequence[float | None]) -> float:
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else -math.inf


def score(model: PipelineModel, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``probability`` and ``margin`` of churn and ``predicted``; a narrow projection."""
    raw = model.transform(as_doubles(df, cols))
    margin = vector_to_array("rawPrediction")[1]
    return raw.select(
        *df.columns,
        vector_to_array("probability")[1].alias("_p"),
        margin.alias("margin"),
        F.col("prediction").cast("int").alias("predicted"),
    ).withColumnRenamed("_p", "probability")


def importance(
    model: PipelineModel,
    df: DataFrame,
    cols: Sequence[str],
    salt: str = "importance",
    single_task_rows: int | None = None,
) -> DataFrame:
    """``feature, auc_drop`` when a feature is replaced by that of another random customer.

    Every customer is paired once with a donor through two hashed rankings; one scoring pass
    covers all features and the intact rows.
    """
    base, rows = settle(
        as_doubles(df.select("customer_id", LABEL, *cols), cols), None, single_task_rows
    )

    def shuffled(name: str) -> DataFrame:
        key = F.md5(F.concat(F.lit(f"{salt}:{name}:"), F.col("customer_id").cast("string")))
        keyed = base.withColumn("_key", key)
        order = [F.col("_key"), F.col("customer_id")]
        return global_rank(keyed, order, (), (), rows, single_task_rows).drop("_key", "rn_rows")

    donors = shuffled("donor").select("rn", *[F.col(c).alias(f"_d_{c}") for c in cols])
    paired = shuffled("receiver").join(donors, "rn")
    variants = [F.struct(F.lit("").alias("feature"), *cols)]
    for j in cols:
        variants.append(
            F.struct(
                F.lit(j).alias("feature"),
                *[F.col(f"_d_{c}").alias(c) if c == j else F.col(c) for c in cols],
            )
        )
    rows = paired.select("customer_id", LABEL, F.inline(F.array(*variants)))
    areas = auc(
        score(model, rows, cols), by=["feature"], single_task_rows=single_task_rows
    )
    areas, _ = freeze(areas)  # one row per feature
    intact = areas.where("feature = ''").select("auc").scalar()
    return areas.where("feature <> ''").select("feature", (intact - F.col("auc")).alias("auc_drop"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
