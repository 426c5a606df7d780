"""The rule engine: registered checks that turn a DataFrame into findings."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.errors import DuplicateRuleError, InvalidRuleResultError, RuleExecutionError, UnknownRuleError
from geolith.storage import Scratch

SEVERITIES = ("info", "warning", "error", "critical")
CATEGORIES = ("attribute", "completeness", "geometry", "metadata", "topology")
FINDING_COLUMNS = ("message", "feature_id")


@dataclass(frozen=True)
class Rule:
    """A named check. execute maps a DataFrame to its findings (message, feature_id); none means passed."""

    id: str
    name: str
    execute: Callable[[DataFrame], DataFrame]
    description: str = ""
    severity: str = "error"
    category: str = "completeness"

    def __post_init__(self):
        if not self.id.strip() or self.severity not in SEVERITIES or self.category not in CATEGORIES:
            raise ValueError("a rule needs an id, a known severity and a known category")


class RuleRegistry:
    """Rules by id, in the order of registration."""

    def __init__(self, rules: Iterable[Rule] = ()):
        self._rules: dict[str, Rule] = {}
        for rule in rules:
            self.register(rule)

    def register(self, rule: Rule) -> None:
        if rule.id in self._rules:
            raise DuplicateRuleError(rule.id)
        self._rules[rule.id] = rule

    def select(self, ids: Iterable[str] | None = None) -> list[Rule]:
        if ids is None:
            return list(self._rules.values())
        ids = list(ids)
        if unknown := [i for i in ids if i not in self._rules]:
            raise UnknownRuleError(", ".join(unknown))
        return [self._rules[i] for i in ids]


RESULTS = "rule_seq int, rule_id string, status string, findings bigint, error string"
FINDINGS = "rule_seq int, rule_id string, message string, feature_id string"


@dataclass(frozen=True)
class RuleOutcome:
    """results: one row for each selected rule. findings: what the rules found, one row each."""

    results: DataFrame
    findings: DataFrame


def execute_rules(frame: DataFrame, registry: RuleRegistry, ids: Iterable[str] | None = None, raise_errors: bool = False) -> RuleOutcome:
    """Run the selected rules, each as a job of its own, so that one that fails, be it in planning or in a task, leaves the others' results alone.

    results: rule_seq, rule_id, status (passed, failed, error), findings, error, in request order; findings: rule_seq,
    rule_id, message, feature_id, written by the rule's job. A rule that raises has status error and no findings, or raises
    RuleExecutionError with raise_errors; one that returns something other than findings raises InvalidRuleResultError.
    """
    spark = frame.sparkSession
    scratch, rows, found = Scratch(spark, "rules"), [], None
    for seq, rule in enumerate(registry.select(ids)):
        try:
            out = rule.execute(frame)
            if not isinstance(out, DataFrame) or not set(FINDING_COLUMNS) <= set(out.columns):
                raise InvalidRuleResultError(rule.id)
            kept = scratch.save(out.select(F.lit(seq).alias("rule_seq"), F.lit(rule.id).alias("rule_id"), F.col("message").cast("string").alias("message"), F.col("feature_id").cast("string").alias("feature_id")))
            n = kept.count()
        except InvalidRuleResultError:
            raise
        except Exception as error:
            if raise_errors:
                raise RuleExecutionError(rule.id, error) from error
            rows.append((seq, rule.id, "error", 0, str(error).splitlines()[0] if str(error) else type(error).__name__))
            continue
        rows.append((seq, rule.id, "failed" if n else "passed", n, None))
        found = kept if found is None else found.unionByName(kept)
    return RuleOutcome(spark.createDataFrame(rows, RESULTS), found if found is not None else spark.createDataFrame([], FINDINGS))


def run_rules(frame: DataFrame, registry: RuleRegistry, ids: Iterable[str] | None = None, raise_errors: bool = False) -> DataFrame:
    """The results of execute_rules."""
    return execute_rules(frame, registry, ids, raise_errors).results


def merge_findings(merged: DataFrame, findings: DataFrame) -> DataFrame:
    """The findings of all parts (part, rule_id, ...) that count after merge_results: those of rules that failed in no part."""
    return findings.join(merged.where("status = 'failed'").select("rule_id"), "rule_id", "left_semi")


def merge_results(partials: DataFrame) -> DataFrame:
    """One row for each rule of partial results (rule_seq, part, rule_id, status, findings, error): an error wins, its messages joined in order of parts; else findings add up."""
    errors = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == "error", F.struct("part", "error")))), lambda e: e["error"]), "; ")  # one message for each part that failed
    out = partials.groupBy("rule_id").agg(F.min("rule_seq").alias("rule_seq"), F.max(F.col("status") == "error").alias("bad"), F.sum("findings").alias("n"), errors.alias("e"))
    status = F.when(F.col("bad"), "error").when(F.col("n") > 0, "failed").otherwise("passed")
    return out.select("rule_seq", "rule_id", status.alias("status"), F.when(F.col("bad"), F.lit(0)).otherwise(F.col("n")).alias("findings"), F.when(F.col("bad"), F.col("e")).alias("error"))


def not_empty(rule_id: str = "dataset.not_empty") -> Rule:
    """The dataset has at least one row."""

    def execute(frame: DataFrame) -> DataFrame:
        return frame.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("dataset has no rows").alias("message"), F.lit(None).cast("string").alias("feature_id"))

    return Rule(rule_id, "Dataset is not empty", execute)
