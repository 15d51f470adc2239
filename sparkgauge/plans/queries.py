"""Queries over the tables, with the SQL that each is held against."""

from __future__ import annotations

from . import datasets, graphs, reports, runs, telemetry, traces, workload

QUERIES: dict = telemetry.QUERIES | datasets.QUERIES | graphs.QUERIES | workload.QUERIES | runs.QUERIES | reports.QUERIES | traces.QUERIES
SQL: dict[str, str] = telemetry.SQL | datasets.SQL | graphs.SQL | workload.SQL | runs.SQL | reports.SQL | traces.SQL
