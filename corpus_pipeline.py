"""The corpus pipeline: its stages are in ``facetry.llm.pipeline``, and this module belongs to that subpackage.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)`` and returns the next one's rows.
``run(spark, sf_dir)`` applies them to ``documents``.
"""

from facetry.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
