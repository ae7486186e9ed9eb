"""Filters, sorted reads and lookups joins over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from frota.functions import status as st
from frota.operators.latest import latest_per_key


def waiting_orders(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("status").isin(st.WAITING) & F.col("id_entregador").isNull())


def available_couriers(couriers: DataFrame) -> DataFrame:
    return couriers.where(
        (F.col("status") == st.COURIER_AVAILABLE)
        & F.col("latitude").isNotNull()
        & F.col("longitude").isNotNull()
    )


def order_history(events: DataFrame, order_ids: DataFrame | None = None) -> DataFrame:
    """Every event of the asked orders (all, if none are named), oldest first."""
    if order_ids is not None:
        events = events.join(order_ids.select("id_pedido"), "id_pedido", "left_semi")
    return events.orderBy("id_pedido", "ts")


def order_histories(order_ids: DataFrame, events: DataFrame) -> DataFrame:
    """(id_pedido, found, historico): every asked order once, its events as an array by time.

    An order without events has ``found`` false and an empty array. An order has few events; the array holds one order's.
    """
    shown = [c for c in ("ts", "status", "event_id", "id_entregador") if c in events.columns]
    asked = order_ids.select("id_pedido").distinct()
    history = (
        events.join(asked, "id_pedido", "left_semi")
        .groupBy("id_pedido")
        .agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("historico"))
    )
    empty = F.expr("array()").cast(history.schema["historico"].dataType)
    return asked.join(history, "id_pedido", "left").select(
        "id_pedido", F.col("historico").isNotNull().alias("found"), F.coalesce("historico", empty).alias("historico")
    )


def customer_orders(customer_ids: DataFrame, customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders by ascending id per asked customer; ``found`` is false for unknown customers."""
    known = customers.select("id_cliente", F.lit(True).alias("_known"))
    return (
        customer_ids.select("id_cliente")
        .distinct()
        .join(known, "id_cliente", "left")
        .join(orders.select("id_cliente", "id_pedido", "status"), "id_cliente", "left")
        .select(
            "id_cliente",
            F.col("_known").isNotNull().alias("found"),
            F.when(F.col("_known"), F.col("id_pedido")).alias("id_pedido"),
            F.when(F.col("_known"), F.col("status")).alias("status"),
        )
        .orderBy("id_cliente", "id_pedido")
    )


def current_allocation(allocations: DataFrame, write_seq: str = "id_pedido") -> DataFrame:
    """Latest allocation per courier; order and routes only while it is active."""
    latest = latest_per_key(allocations, ["id_entregador"], ["ts", write_seq])
    active = F.col("status").isin(st.ALLOCATION_ACTIVE)
    shown = [c for c in allocations.columns if c in ("id_pedido", "rota_restaurante", "rota_cliente")]
    return latest.select("id_entregador", *[F.when(active, F.col(c)).alias(c) for c in shown])


def newly_allocated(current: DataFrame, idle_couriers: DataFrame) -> DataFrame:
    """Idle couriers that now hold an active allocation."""
    return current.where(F.col("id_pedido").isNotNull()).join(
        idle_couriers.select("id_entregador"), "id_entregador", "left_semi"
    )


def open_orders_by_status(orders: DataFrame) -> DataFrame:
    return (
        orders.where(F.col("status").isin("CONFIRMED", "PREPARING"))
        .groupBy("status")
        .agg(F.count("*").alias("n_pedidos"))
    )


def order_positions(orders: DataFrame, restaurants: DataFrame, customers: DataFrame) -> DataFrame:
    """Each order with the coordinates of its restaurant and its customer."""
    return (
        orders.select("id_pedido", "id_restaurante", "id_cliente")
        .join(
            restaurants.select(
                "id_restaurante", F.col("latitude").alias("rest_lat"), F.col("longitude").alias("rest_lon")
            ),
            "id_restaurante",
        )
        .join(
            customers.select("id_cliente", F.col("latitude").alias("cli_lat"), F.col("longitude").alias("cli_lon")),
            "id_cliente",
        )
        .select("id_pedido", "id_restaurante", "id_cliente", "rest_lat", "rest_lon", "cli_lat", "cli_lon")
    )


def check_references(requests: DataFrame, customers: DataFrame, restaurants: DataFrame) -> DataFrame:
    """New-order requests with ``motivo`` null when both references exist."""
    return (
        requests.join(customers.select("id_cliente", F.lit(True).alias("_cli")), "id_cliente", "left")
        .join(restaurants.select("id_restaurante", F.lit(True).alias("_res")), "id_restaurante", "left")
        .withColumn(
            "motivo",
            F.when(F.col("_cli").isNull(), "CLIENTE_NAO_ENCONTRADO").when(
                F.col("_res").isNull(), "RESTAURANTE_NAO_ENCONTRADO"
            ),
        )
        .drop("_cli", "_res")
    )


def idle_customers(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers without an open order."""
    still_open = orders.where(F.col("status") != "DELIVERED").select("id_cliente")
    return customers.select("id_cliente").join(still_open, "id_cliente", "left_anti")
