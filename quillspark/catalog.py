"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from quillspark.queries import aggregates, batches, contracts, evidence, excerpts, planning, relational, retention, scalars, state, texts, windows

MODULES = (planning, scalars, relational, windows, aggregates, texts, state, evidence, excerpts, batches, contracts, retention)
FLAGSHIP = "flagship_decisions"
QUERIES: dict = {}
ORACLES: dict = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
