"""Every registered query; importing this package fills the registry."""

from ballast.plans.registry import ORACLES, QUERIES

from ballast.plans import checked, decisions, landed, matching, network, rollups, scalars  # noqa: F401,E402  isort: skip

__all__ = ["ORACLES", "QUERIES"]
