"""All registered queries of the corpus engine."""

from __future__ import annotations

from . import corpus, curation, derived, evaluation, extras, plugins, reports, running  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
