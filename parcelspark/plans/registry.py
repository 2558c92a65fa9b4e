"""All registered queries of the property operators, with the SQL that each is held against."""

from __future__ import annotations

from . import explore, files, keep, matching

QUERIES: dict = {**matching.QUERIES, **explore.QUERIES, **keep.QUERIES, **files.QUERIES}
ORACLE: dict = {**matching.ORACLE, **explore.ORACLE, **keep.ORACLE, **files.ORACLE}
