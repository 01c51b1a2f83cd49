"""All queries over the engine's own operators, with the SQL that answers the same."""

from __future__ import annotations

from . import dialog_plans, metric_plans, sampling_plans, source_plans, span_plans, task_plans, text_plans

_ALL = (text_plans, dialog_plans, sampling_plans, span_plans, metric_plans, task_plans, source_plans)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _ALL for k, v in m.ORACLES.items()}
