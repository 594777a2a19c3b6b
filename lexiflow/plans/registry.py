"""Named queries of the library and the SQL they are checked against."""

from __future__ import annotations

from lexiflow.plans import accounts, chain, extras, families, paths, rules, search, units, variants  # noqa: F401
from lexiflow.plans.base import ORACLE_SQL, QUERIES  # noqa: F401

#: Word overlap of the English and the French population.
flagship = search.a5
