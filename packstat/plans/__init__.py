"""Registered queries on the driver tables and the SQL they are checked against."""

from packstat.plans import geometry_queries, io_queries, mesh_queries, sampling_queries, spatial_queries, stats_queries, telemetry_queries, voronoi_queries
from packstat.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "geometry_queries", "io_queries", "mesh_queries", "sampling_queries", "spatial_queries", "stats_queries", "telemetry_queries", "voronoi_queries"]
