"""Geometry text and binary codecs, exact predicates and float measures (no native library)."""
