"""Shared tables and files, as the rest of the library keeps them."""

from ..sources.shared import discard, materialise, release, shared_dir

__all__ = ["discard", "materialise", "release", "shared_dir"]
