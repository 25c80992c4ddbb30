"""Deciders as column expressions.

A decider is a function ``answers column -> result column``: the answers that
count for a request are an array of ``collect.ANSWER`` in order of arrival (by
latency, then model key), never empty.  The same object serves the batch plan
(``serve``, ``collect_vote``), the responses as an input
(``collect_responses``), the serving stream and the stateful collector; it is
evaluated on the JVM in the stage that collects the answers.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Decider = Callable[[Column], Column]


def _total(answers: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(answers, F.lit(0.0), lambda acc, a: acc + value(a).cast("double"))


def vote(threshold: float = 0.5) -> Decider:
    """The built-in vote: mean of the answers (none given: 0) below ``threshold`` -> 0, else 1."""
    return lambda answers: F.when(_total(answers, lambda a: F.coalesce(a["result"], F.lit(0))) / F.size(answers)
                                  < F.lit(threshold), 0).otherwise(1).cast("int")


def first_answer(default: int = 0) -> Decider:
    """The earliest answer with a result decides; ``default`` if none has one."""
    return lambda answers: F.coalesce(F.get(F.filter(answers, lambda a: a["result"].isNotNull()), F.lit(0))["result"],
                                      F.lit(default)).cast("int")


def weighted_vote(weights: Mapping[str, float], other: float = 1.0, threshold: float = 0.5) -> Decider:
    """Votes weighted by model key (``other`` for keys not named): the weighted share of ones, 0 below ``threshold``."""
    pairs = [x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]

    def weight(a: Column) -> Column:
        return F.coalesce(F.create_map(*pairs)[a["data_model"]], F.lit(float(other))) if pairs else F.lit(float(other))

    return lambda answers: F.when(
        F.coalesce(F.try_divide(_total(answers, lambda a: weight(a) * F.coalesce(a["result"], F.lit(0))),
                                _total(answers, weight)), F.lit(0.0)) < F.lit(threshold), 0).otherwise(1).cast("int")


def all_agree(default: int = 0) -> Decider:
    """The common result of all answers; ``default`` where they differ or one is missing."""
    def decide(answers: Column) -> Column:
        results = F.array_distinct(F.transform(answers, lambda a: a["result"]))
        return F.when(F.size(results) == 1, F.coalesce(F.get(results, F.lit(0)), F.lit(default))).otherwise(default).cast("int")
    return decide
