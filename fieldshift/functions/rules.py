"""Interval rules that turn a continuous column into classes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A class with its bounds; ``None`` is unbounded, the flags say whether a bound belongs to the class."""

    class_id: int
    label: str
    lower: float | None
    upper: float | None
    lower_closed: bool = True
    upper_closed: bool = False

    def __post_init__(self) -> None:
        if self.lower is not None and self.upper is not None and self.lower > self.upper:
            raise ValueError(f"class {self.class_id}: lower bound above upper bound")


# Class numbers, labels and bounds of the index and of its change.
INDEX_RULES = (
    Rule(1, "менее 0.10", None, 0.10),
    Rule(2, "0.10-0.25", 0.10, 0.25),
    Rule(3, "0.25-0.45", 0.25, 0.45),
    Rule(4, "0.45-0.65", 0.45, 0.65, True, True),
    Rule(5, "более 0.65", 0.65, None, False, True),
)
CHANGE_RULES = (
    Rule(1, "Значительное ухудшение", None, -0.20),
    Rule(2, "Умеренное ухудшение", -0.20, -0.05),
    Rule(3, "Без изменений", -0.05, 0.05),
    Rule(4, "Умеренное улучшение", 0.05, 0.20),
    Rule(5, "Значительное улучшение", 0.20, None, True, True),
)
LOSS_CLASSES, GAIN_CLASSES = (1, 2), (4, 5)

#: Stands for "no class".
NO_CLASS = 0


def single(value: float) -> Column:
    """A FLOAT literal: bounds must be compared in the precision of the values, or boundary cells flip."""
    return F.lit(value).cast("float")


def holds(value: Column, rule: Rule) -> Column:
    test = F.lit(True)
    if rule.lower is not None:
        test &= (value >= single(rule.lower)) if rule.lower_closed else (value > single(rule.lower))
    if rule.upper is not None:
        test &= (value <= single(rule.upper)) if rule.upper_closed else (value < single(rule.upper))
    return test


def _tiles(rules: Sequence[Rule]) -> bool:
    """Whether each rule begins just where the one before ends."""
    ends = [(a.upper, not a.upper_closed) for a in rules[:-1]]
    return rules[0].lower is None and rules[-1].upper is None and ends == [(b.lower, b.lower_closed) for b in rules[1:]]


def classify(value: Column, rules: Sequence[Rule]) -> Column:
    """The class of a FLOAT column; of overlapping rules the last wins; null, non-finite and uncovered values have class 0.

    Rules that tile the line are read as steps, which names the value once per bound.
    """
    if _tiles(rules):
        steps = [
            F.when((value >= single(b.lower)) if b.lower_closed else (value > single(b.lower)), F.lit(b.class_id - a.class_id)).otherwise(F.lit(0))
            for a, b in zip(rules, rules[1:])
        ]
        found = sum(steps, F.lit(rules[0].class_id))
    else:
        found = F.lit(NO_CLASS)
        for rule in rules:
            found = F.when(holds(value, rule), F.lit(rule.class_id)).otherwise(found)
    return F.when(F.abs(value) < F.lit(float("inf")), found).otherwise(F.lit(NO_CLASS)).cast("int")


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(class_id, label) in rule order, a handful of rows."""
    return spark.createDataFrame([(r.class_id, r.label) for r in rules], "class_id int, label string")


def midpoint(rule: Rule, falling: bool) -> float:
    """Where a cell that moves into the class goes: the middle, or for half-open classes just inside the finite bound."""
    import math

    if rule.lower is not None and rule.upper is not None:
        return (rule.lower + rule.upper) / 2
    if rule.upper is None:
        return rule.lower if falling else math.nextafter(rule.lower, 1.0)
    return math.nextafter(rule.upper, -1.0) if falling else rule.upper
