"""All registered queries of the core, and the SQL that must agree."""

from __future__ import annotations

from . import hygiene, records, retrieval, workflows

QUERIES = {**retrieval.QUERIES, **records.QUERIES, **hygiene.QUERIES, **workflows.QUERIES}
ORACLE = {**retrieval.ORACLE, **records.ORACLE, **hygiene.ORACLE, **workflows.ORACLE}
