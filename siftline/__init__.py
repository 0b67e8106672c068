"""siftline: rule-driven qualification of posting tables on Spark."""

from .vocab import RuleSet, starter_rules

__all__ = ["RuleSet", "starter_rules"]
