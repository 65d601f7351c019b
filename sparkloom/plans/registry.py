"""All queries over the reference operators, with the DuckDB SQL each is compared with."""

from __future__ import annotations

from . import catalog, details, ingest, listings, nearest, outputs, traffic

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (catalog, listings, traffic, nearest, details, ingest, outputs):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
