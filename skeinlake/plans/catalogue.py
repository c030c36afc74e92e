"""All registered queries and their SQL."""

from __future__ import annotations

from . import audits, curation, documents, evaluation, learner, retrieval, sessions, streams

_ALL = (retrieval, curation, evaluation, learner, sessions, documents, streams, audits)
QUERIES = {n: f for m in _ALL for n, f in m.register.queries.items()}
ORACLES = {n: s for m in _ALL for n, s in m.register.oracles.items()}
