"""All registered queries; importing the plan modules fills the registry."""

from opslens.plans import assess, captures, identity, messages, state, streams, usage  # noqa: F401
from opslens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
