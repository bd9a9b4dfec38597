"""Queries by name and their SQL."""

from __future__ import annotations

from ledgerlens.plans import calibration, classification, enrichment, payloads, scalars, spending

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (scalars, classification, enrichment, spending, payloads, calibration):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
