"""All registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from airlens.plans import blocks, editorial, ingest, report, stories, streams, transcripts

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (ingest, transcripts, stories, blocks, report, editorial, streams):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
