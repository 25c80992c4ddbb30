"""quorum - versioned-model ensemble serving as Spark DataFrame operators.

Batch::

    from quorum import serve
    out = serve(measurements, registry, config, latency=..., quorum="all")

Streaming: ``quorum.streaming.registry_job``, ``quorum.streaming.serve_stream``
and ``quorum.streaming.collector``.
"""

from quorum.operators.asof import asof_join, interval_join, validity_intervals
from quorum.operators.collect import (collect_vote, late_responses, mark_counted,
                                      responses_in_time, with_answers, with_arrival_rank)
from quorum.operators.decide import decide_with, majority_decider
from quorum.operators.ensemble import SliceModel, ensemble_score
from quorum.operators.route import (known_models, no_model, route, route_requests, servable,
                                    version_intervals, with_epoch, with_guid, with_timeout)
from quorum.operators.score import Scorer, register_scorer, score_linear, score_with
from quorum.operators.stats import collector_stats, current_model_stats, model_stats, state_report
from quorum.operators.window import last_n_window
from quorum.plans.serve import scored_requests, serve

__all__ = [
    "asof_join", "interval_join", "validity_intervals",
    "collect_vote", "late_responses", "mark_counted", "responses_in_time", "with_answers",
    "with_arrival_rank", "decide_with", "majority_decider", "SliceModel", "ensemble_score",
    "known_models", "no_model", "route", "route_requests", "servable", "version_intervals",
    "with_epoch", "with_guid", "with_timeout", "Scorer", "register_scorer", "score_linear",
    "score_with", "collector_stats", "current_model_stats", "model_stats", "state_report",
    "last_n_window", "scored_requests", "serve",
]
