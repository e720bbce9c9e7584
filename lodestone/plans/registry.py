"""Every query of the engine and its oracle SQL."""

from lodestone.plans import catalogs, context, extras, files, indexes, joins, tables, texts, vectors  # noqa: F401  (each registers its queries)
from lodestone.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
