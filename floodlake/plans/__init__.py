"""Named queries over whole tables, and DuckDB SQL for their rows."""

from . import exposure_queries, network_queries, overlay_queries, pixel_queries, record_queries, scene_queries

_MODULES = (scene_queries, pixel_queries, exposure_queries, overlay_queries, network_queries, record_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
