"""All core queries and their SQL."""

from __future__ import annotations

from geolith.plans import audits, problems

QUERIES = {**problems.QUERIES, **audits.QUERIES}
ORACLES: dict[str, str] = {**problems.ORACLES, **audits.ORACLES}
FLAGSHIP = audits.duplicate_pairs
