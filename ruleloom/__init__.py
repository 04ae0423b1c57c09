"""Fuzzy rule-based classification of large tables on Spark."""

from ruleloom.params import Params
from ruleloom.plans.classify import classify
from ruleloom.plans.crossval import cross_validate
from ruleloom.plans.learn import Model, learn
from ruleloom.operators.profile import profile
from ruleloom.schema import RuleSchema, Variable

__all__ = ["Model", "Params", "RuleSchema", "Variable", "classify", "cross_validate", "learn", "profile"]
