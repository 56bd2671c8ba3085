"""Every query of the sequence and record operators, with the SQL that it must agree with."""

from __future__ import annotations

from .plans import align, kmers, models, more, msa, pairs, records, sequences  # noqa: F401
from .plans.registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
