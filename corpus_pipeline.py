"""The corpus pipeline: its stages, the SQL of its rows (None where SQL can't express a stage), and the whole run."""

from riskloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
