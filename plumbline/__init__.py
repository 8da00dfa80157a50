"""Plumbline: data-quality checks, profiles, repairs and run history on Spark DataFrames."""

from plumbline.operators.loop import run_loop
from plumbline.operators.snapshots import snapshot_diff
from plumbline.operators.suggest import suggest_rules
from plumbline.operators.validate import validate
from plumbline.plans.rules import Rule, RuleCatalog
from plumbline.sources.history import History

__all__ = ["History", "Rule", "RuleCatalog", "run_loop", "snapshot_diff", "suggest_rules", "validate"]
