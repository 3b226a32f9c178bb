"""Registered queries over the test tables and the SQL they are checked against."""

from . import derived, families, guard, more, prep, rest, score, text

QUERIES = {**text.QUERIES, **prep.QUERIES, **guard.QUERIES, **score.QUERIES, **more.QUERIES, **derived.QUERIES, **families.QUERIES, **rest.QUERIES}
ORACLES = {**text.ORACLES, **prep.ORACLES, **guard.ORACLES, **score.ORACLES, **more.ORACLES, **derived.ORACLES, **families.ORACLES, **rest.ORACLES}
