"""Rows describing a piece of track on a route."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Advisory texts of a track row.
HIGH_CONGESTION = "High congestion — expect slow orders"
HISTORICALLY_DELAYED = "Historically delayed block"
CLEARANCE_VIOLATION = "Clearance violation on this tract"


def exceeds(cargo: tuple[Column, Column, Column], limits: tuple[Column, Column, Column]) -> Column:
    """True where height, width or weight is strictly above its limit."""
    h, w, t = (c > m for c, m in zip(cargo, limits))
    return h | w | t


def advisory(factor: Column, delay_h: Column, blocked: Column) -> Column:
    return F.when(factor >= 1.5, HIGH_CONGESTION).when(delay_h >= 1, HISTORICALLY_DELAYED).when(
        blocked, CLEARANCE_VIOLATION
    )


def progress_pct(phase: Column, is_current: Column, fraction: Column) -> Column:
    return F.when((phase == "CURRENT") & is_current, F.round(fraction * 100).cast("int"))


def route_label(source: Column, dest: Column) -> Column:
    return F.concat_ws(" → ", source, dest)
