"""Registered queries of the request-analytics operators, with their SQL twins."""

from __future__ import annotations

from . import q_eval, q_models, q_requests

FLAGSHIP = "top_flags"
QUERIES: dict = {**q_requests.QUERIES, **q_eval.QUERIES, **q_models.QUERIES}
ORACLES: dict[str, str] = {**q_requests.ORACLES, **q_eval.ORACLES, **q_models.ORACLES}
