"""The order-status domain."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The life of an order, in the only legal sequence.
LIFECYCLE = ["CONFIRMED", "PREPARING", "READY_FOR_PICKUP", "PICKED_UP", "IN_TRANSIT", "DELIVERED"]
# An order waits for a courier in these, and needs one from PICKED_UP on.
WAITING = ["PREPARING", "READY_FOR_PICKUP"]
FIRST_STEP_WITH_COURIER = 3
# Courier and allocation statuses.
COURIER_AVAILABLE, COURIER_BUSY = "AVAILABLE", "BUSY"
ALLOCATION_ACTIVE = ["ATIVO", "ATIVA"]
ALLOCATION_WRITTEN, ALLOCATION_RELEASED = "ATIVO", "INATIVA"


def in_domain(status: Column) -> Column:
    return status.isin(LIFECYCLE)


def step_of(status: Column) -> Column:
    """0-based position in the lifecycle; null outside the domain. Fixed width, so it hashes well."""
    names = F.array(*[F.lit(s) for s in LIFECYCLE])
    return F.nullif(F.array_position(names, status), F.lit(0)).cast("int") - 1


def status_at(step: Column) -> Column:
    names = F.array(*[F.lit(s) for s in LIFECYCLE])
    return F.get(names, step)


def next_status(status: Column) -> Column:
    return status_at(step_of(status) + 1)
