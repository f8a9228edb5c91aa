"""Queries over the bundled tables, each with the SQL that checks it."""

from __future__ import annotations

from . import analysis, context, costs, evaluation, facts, retrieval, scoring, storage, streams, texts

MODULES = (texts, facts, retrieval, context, analysis, costs, scoring, streams, evaluation, storage)

QUERIES = {name: run for module in MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
