"""The pipeline over documents: STAGES, run and ORACLE_SQL."""

from loxo.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
