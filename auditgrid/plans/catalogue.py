"""All queries of the engine, with the SQL that they must equal."""

from __future__ import annotations

from . import q_evidence, q_extra, q_metrics, q_more, q_rows, q_text  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
