"""The corpus pipeline: quality, exact dedup, near dedup, mixing, encoding. Its stages are in lodestone.llm.pipeline."""

from __future__ import annotations

from lodestone.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
