"""Registered queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from . import analytics, catalogs, fields, grids, profiles, scale, streams, validation

QUERIES = {**fields.QUERIES, **analytics.QUERIES, **profiles.QUERIES, **streams.QUERIES, **validation.QUERIES, **catalogs.QUERIES, **scale.QUERIES, **grids.QUERIES}
ORACLES = {**fields.ORACLES, **analytics.ORACLES, **profiles.ORACLES, **streams.ORACLES, **catalogs.ORACLES, **scale.ORACLES, **grids.ORACLES}
flagship = fields.flagship
