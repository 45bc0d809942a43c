"""All named queries of the engine and their SQL, in the order of the survey's list."""

from __future__ import annotations

from arkose.functions import scalar, udfs
from arkose.operators import aggregates, histories, joins, masks, minhash, relational, sketches, text, windows
from arkose.sources import formats
from arkose.streaming import events

_MODULES = (relational, formats, joins, aggregates, windows, scalar, udfs, events, text, minhash, sketches, histories, masks)


def queries() -> dict:
    return {k: q for m in _MODULES for k, q in m.R.queries.items()}


def oracles() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.R.oracles.items()}
