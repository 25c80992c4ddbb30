"""Batch ensemble scoring over feature vectors at rest (M5).

The same fan-out -> score -> vote as the serving graph, for a table whose
rows already hold the feature vector.  The models are a short parameter list
(one column expression each), so no join is needed at all: every row is
scored by every model inside one codegen'd projection, and the vote is an
array aggregate over the row's own answers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.functions.columns import VOTER_MODEL, argmax2


@dataclass(frozen=True)
class SliceModel:
    """Two-class linear model over ``vec[start .. start+length-1]`` (1-based):
    class-1 logit = ``sum(weights * slice) + bias`` (weights default 1)."""
    name: str
    start: int
    length: int
    bias: float = 0.0
    weights: tuple[float, ...] | None = None

    def logit(self, vec: Column) -> Column:
        sl = F.slice(vec, self.start, self.length)
        if self.weights is None:
            s = F.aggregate(sl, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
        else:
            w = F.array(*[F.lit(float(x)) for x in self.weights])
            s = F.aggregate(F.zip_with(sl, w, lambda x, y: x.cast("double") * y),
                            F.lit(0.0).cast("double"), lambda a, x: a + x)
        # a vector that ends before the slice does has no logit
        return F.when(F.size(sl) == self.length, s + F.lit(float(self.bias)))

    def score(self, vec: Column) -> Column:
        return argmax2(F.lit(0.0), self.logit(vec))


def ensemble_score(df: DataFrame, vec_col: str, models: Sequence[SliceModel],
                   source: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """Adds one column per model (its class), ``result`` (majority vote,
    tie -> 1, NULL answers vote 0), ``model`` and ``source``."""
    vec = F.col(vec_col)
    out = df
    for m in models:
        out = out.withColumn(m.name, m.score(vec))
    votes = F.array(*[F.coalesce(F.col(m.name), F.lit(0)).cast("double") for m in models])
    mean = F.aggregate(votes, F.lit(0.0), lambda a, x: a + x) / F.lit(float(len(models)))
    out = (out.withColumn("result", F.when(mean < F.lit(threshold), 0).otherwise(1).cast("int"))
              .withColumn("model", F.lit(VOTER_MODEL)))
    if source is not None:
        out = out.withColumn("source", source.cast("int"))
    return out
