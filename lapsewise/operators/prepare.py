"""Preparation of features as stages of a fitted pipeline.

Limits, fill values and categories are learnt from the training rows when the pipeline is fitted,
and are saved and loaded with it; scoring never looks at other rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.operators.features import impute_values, winsor_limits


class _Columns(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    def over(self, inputs: Sequence[str], outputs: Sequence[str]):
        return self._set(inputCols=list(inputs), outputCols=list(outputs))

    def _pairs(self) -> list[tuple[str, str]]:
        return list(zip(self.getInputCols(), self.getOutputCols()))


class _Floats(_Columns):
    """Parameters that are one number for each column."""

    def numbers(self, param: Param) -> list[float]:
        return self.getOrDefault(param)


class Clipped(Model, _Floats):
    """Pulls values beyond a column's limits to the limits; NULL stays NULL."""

    lows = Param(Params._dummy(), "lows", "lowest value of each column", TypeConverters.toListFloat)
    highs = Param(Params._dummy(), "highs", "highest value of each column", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        limits = zip(self._pairs(), self.numbers(self.lows), self.numbers(self.highs))
        return dataset.withColumns(
            {
                out: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.lit(lo)), F.lit(hi)))
                for (c, out), lo, hi in limits
            }
        )


class Clip(Estimator, _Columns):
    """Learns the exact quantiles ``low`` and ``high`` of each column (F12)."""

    low = Param(Params._dummy(), "low", "lower quantile", TypeConverters.toFloat)
    high = Param(Params._dummy(), "high", "upper quantile", TypeConverters.toFloat)

    def between(self, low: float, high: float) -> Clip:
        return self._set(low=low, high=high)

    def _fit(self, dataset: DataFrame) -> Clipped:
        cols = self.getInputCols()
        found = winsor_limits(dataset, cols, self.getOrDefault(self.low), self.getOrDefault(self.high)).first()

        def limit(name: str, none: float) -> float:
            # A column without training values has no limits.
            return none if found[name] is None else float(found[name])

        model = Clipped().over(cols, self.getOutputCols())
        return model._set(
            lows=[limit(f"{c}_lo", -math.inf) for c in cols], highs=[limit(f"{c}_hi", math.inf) for c in cols]
        )


class Filled(Model, _Floats):
    """Replaces NULL by a column's value and tells where, in ``<output>_missing``."""

    values = Param(Params._dummy(), "values", "value of each column's missing cells", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        filled = zip(self._pairs(), self.numbers(self.values))
        return dataset.withColumns(
            {out: F.coalesce(F.col(c).cast("double"), F.lit(value)) for (c, out), value in filled}
            | {f"{out}_missing": F.col(c).isNull().cast("double") for c, out in self._pairs()}
        )


class Fill(Estimator, _Columns):
    """Learns each column's training mean or median (F11); without any value that is 0."""

    how = Param(Params._dummy(), "how", "'mean' or 'median'", TypeConverters.toString)

    def by(self, how: str) -> Fill:
        return self._set(how=how)

    def _fit(self, dataset: DataFrame) -> Filled:
        cols = self.getInputCols()
        found = impute_values(dataset, dict.fromkeys(cols, self.getOrDefault(self.how))).first()
        values = [0.0 if found is None or found[c] is None else float(found[c]) for c in cols]
        return Filled().over(cols, self.getOutputCols())._set(values=values)


def input_stages(
    cols: Sequence[str], categories: Sequence[str] = (), clip: tuple[float, float] | None = None, how: str = "mean", out: str = "_raw"
) -> list:
    """Unfitted stages from columns to the vector ``out``: numeric columns clipped to quantiles and
    filled, a missing flag each, categories as one-hot vectors (alphabetical; a value or NULL not
    seen in training has a place of its own). All outputs are new columns, ``_p_<column>`` and
    ``_i_``, ``_v_`` for categories."""
    stages: list = []
    filled = [f"_p_{c}" for c in cols]
    if cols and clip is not None:
        clipped = [f"_c_{c}" for c in cols]
        stages.append(Clip().over(cols, clipped).between(*clip))
    if cols:
        stages.append(Fill().over(cols if clip is None else clipped, filled).by(how))
    if categories:
        index, vectors = [f"_i_{c}" for c in categories], [f"_v_{c}" for c in categories]
        stages.append(
            StringIndexer(inputCols=list(categories), outputCols=index, stringOrderType="alphabetAsc", handleInvalid="keep")
        )
        stages.append(OneHotEncoder(inputCols=index, outputCols=vectors, handleInvalid="keep"))
    flags = [f"{c}_missing" for c in filled]
    inputs = [*filled, *flags, *(f"_v_{c}" for c in categories)]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="error")]
