"""Errors of the package."""

from __future__ import annotations


class GeolithError(Exception):
    """Base of all errors."""


class MetadataReadError(GeolithError):
    """A dataset's metadata cannot be read; carries the source and the reason."""

    def __init__(self, source: str, reason: str):
        self.source, self.reason = source, reason
        super().__init__(f"{source}: {reason}")


class ScanError(GeolithError):
    """Reading features failed."""


class UnsupportedFormatError(ScanError):
    pass


class CorruptDatasetError(ScanError):
    pass


class EncodingError(ScanError):
    pass


class MissingCrsError(ScanError):
    pass


class EmptyLayerError(ScanError):
    pass


class ScanMemoryError(ScanError):
    pass


class DatumTransformationError(GeolithError):
    pass


class RuleError(GeolithError):
    pass


class DuplicateRuleError(RuleError):
    pass


class UnknownRuleError(RuleError):
    pass


class InvalidRuleResultError(RuleError):
    pass


class RuleExecutionError(RuleError):
    """A rule raised; carries its id."""

    def __init__(self, rule_id: str, cause: Exception):
        self.rule_id = rule_id
        super().__init__(f"rule {rule_id}: {cause}")
