"""The corpus pipeline: its stages, what it returns and the SQL of that; see waymark.llm.pipeline."""

from __future__ import annotations

from waymark.llm.pipeline import ORACLE_SQL, STAGES, best_fit_packing, decontamination, language_id, near_duplicates, quality_rules, run

__all__ = ["ORACLE_SQL", "STAGES", "best_fit_packing", "decontamination", "language_id", "near_duplicates", "quality_rules", "run"]
