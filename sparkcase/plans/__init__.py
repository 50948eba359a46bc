"""Registered queries over the driver's tables, and their SQL."""

from . import behaviour, evaluation, reconciliation, studies, texts, views

QUERIES: dict = {}
ORACLES: dict = {}
for _slate in (reconciliation.slate, behaviour.slate, texts.slate, evaluation.slate, studies.slate, views.slate):
    QUERIES.update(_slate.queries)
    ORACLES.update(_slate.oracles)
