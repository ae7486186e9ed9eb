"""Live order tracking: two tables of one row a key, joined when read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from frota.operators.tracking import join_positions
from frota.sources.snapshots import Snapshots


def live_tracking(fleet: Snapshots, positions: Snapshots) -> DataFrame:
    """Every order that has an event, with its courier's last position; the last version of both is read and nothing older."""
    return join_positions(fleet.read("situacao").select("id_pedido", "status", "id_entregador"), positions.read("posicoes"))
