"""All registered queries of the inventory engine."""

from stockroom.plans import queries  # noqa: F401  isort: skip
from stockroom.plans import classification, facts, live, records, registry, scan  # noqa: F401  registration

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
