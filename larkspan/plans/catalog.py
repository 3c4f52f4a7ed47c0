"""All queries of the library proper."""

from larkspan.plans import core, extensions, relational, scalars, sequences, streams  # noqa: F401
from larkspan.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
