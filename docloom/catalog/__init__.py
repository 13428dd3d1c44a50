"""Every operator as a query over the given tables."""

from . import aggregates, chunks, filters, ingest, joins, streams, texts, vectors  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
