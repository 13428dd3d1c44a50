"""Scans, file intake and sinks."""

from .tables import SCHEMAS, load, spread  # noqa: F401
