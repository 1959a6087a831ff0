"""The queries over the contact-map operators and the SQL that checks them."""

from __future__ import annotations

from tessera.plans import contact_queries, decay_queries, feature_queries, file_queries, genome_queries, matrix_queries  # noqa: F401  they register themselves
from tessera.plans.register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
