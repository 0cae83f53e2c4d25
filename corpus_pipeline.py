"""The pipeline of loomwork.llm, under the name that the driver looks for."""

from loomwork.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
