"""Every query of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from . import acceptance, cleaning, forecasting, gridding, lifecycle, served, serving, stored

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for part in (gridding, cleaning, forecasting, serving, lifecycle, stored, acceptance, served):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL
