"""Joins without hot tasks, as the whole library uses them."""

from ..operators.skew import HOT_GROUPS, attach

__all__ = ["HOT_GROUPS", "attach"]
