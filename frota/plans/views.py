"""The domain tables as SQL views over the given tables, in text both Spark and DuckDB run.

The road graph has one crossing per supplier on a square grid, so it grows with the data. Customers,
restaurants and orders come from the tables of the same meaning, couriers and telemetry from the
event stream, status updates from the events and new-order requests from the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW = ["customer", "supplier", "orders", "events"]

# view -> (tables and views it reads, text)
VIEWS: dict[str, tuple[list[str], str]] = {
    "malha": (
        ["supplier"],
        "SELECT count(*) AS n, CAST(ceil(sqrt(CAST(count(*) AS DOUBLE))) AS BIGINT) AS w FROM supplier",
    ),
    "grafo_nos": (
        ["supplier", "malha"],
        """SELECT s_suppkey AS node_id, s_suppkey AS node_pos,
 CAST(-23.60 AS DOUBLE) + CAST((s_suppkey - s_suppkey % w) AS DOUBLE) / w * 0.12e0 / w AS lat,
 CAST(-46.70 AS DOUBLE) + CAST(s_suppkey % w AS DOUBLE) * 0.12e0 / w AS lon
 FROM (SELECT s_suppkey, (SELECT w FROM malha) AS w, (SELECT n FROM malha) AS n FROM supplier) s""",
    ),
    # the last crossing has no streets; some streets are one-way; some have a longer parallel lane listed first
    "grafo_arestas": (
        ["supplier", "malha"],
        """SELECT edge_seq, from_node, to_node, weight FROM (
 SELECT s_suppkey*10+1 AS edge_seq, s_suppkey AS from_node, s_suppkey+1 AS to_node, CAST(100 + (s_suppkey*37) % 50 AS DOUBLE) AS weight, n FROM (SELECT s_suppkey, (SELECT w FROM malha) AS w, (SELECT n FROM malha) AS n FROM supplier) s WHERE s_suppkey % w < w-1
 UNION ALL SELECT s_suppkey*10+0, s_suppkey, s_suppkey+1, CAST(105 + (s_suppkey*37) % 50 AS DOUBLE), n FROM (SELECT s_suppkey, (SELECT w FROM malha) AS w, (SELECT n FROM malha) AS n FROM supplier) s WHERE s_suppkey % w < w-1 AND s_suppkey % 10 = 0
 UNION ALL SELECT s_suppkey*10+2, s_suppkey+1, s_suppkey, CAST(100 + (s_suppkey*41) % 50 AS DOUBLE), n FROM (SELECT s_suppkey, (SELECT w FROM malha) AS w, (SELECT n FROM malha) AS n FROM supplier) s WHERE s_suppkey % w < w-1 AND s_suppkey % 7 <> 3
 UNION ALL SELECT s_suppkey*10+3, s_suppkey, s_suppkey+w, CAST(100 + (s_suppkey*43) % 50 AS DOUBLE), n FROM (SELECT s_suppkey, (SELECT w FROM malha) AS w, (SELECT n FROM malha) AS n FROM supplier) s
 UNION ALL SELECT s_suppkey*10+4, s_suppkey+w, s_suppkey, CAST(100 + (s_suppkey*47) % 50 AS DOUBLE), n FROM (SELECT s_suppkey, (SELECT w FROM malha) AS w, (SELECT n FROM malha) AS n FROM supplier) s
) e WHERE from_node < n - 1 AND to_node < n - 1""",
    ),
    "clientes": (
        ["customer"],
        """SELECT c_custkey + 1 AS id_cliente, c_name AS nome,
 CAST(-23.60 AS DOUBLE) + CAST((c_custkey*31) % 1100 AS DOUBLE) / 10000e0 + CAST(c_custkey AS DOUBLE) / 1e7 AS latitude,
 CAST(-46.70 AS DOUBLE) + CAST((c_custkey*57) % 1100 AS DOUBLE) / 10000e0 + CAST(c_custkey AS DOUBLE) / 1e7 AS longitude FROM customer""",
    ),
    "restaurantes": (
        ["supplier"],
        """SELECT s_suppkey + 1 AS id_restaurante, s_name AS nome,
 CAST(-23.60 AS DOUBLE) + CAST((s_suppkey*133) % 1100 AS DOUBLE) / 10000e0 + CAST(s_suppkey AS DOUBLE) / 1e7 AS latitude,
 CAST(-46.70 AS DOUBLE) + CAST((s_suppkey*211) % 1100 AS DOUBLE) / 10000e0 + CAST(s_suppkey AS DOUBLE) / 1e7 AS longitude FROM supplier""",
    ),
    "entregadores": (
        ["events"],
        """SELECT id_entregador, CASE WHEN id_entregador % 5 = 0 THEN 'BUSY' ELSE 'AVAILABLE' END AS status,
 CASE WHEN id_entregador % 17 = 16 THEN NULL ELSE CAST(-23.60 AS DOUBLE) + CAST((id_entregador*71) % 1100 AS DOUBLE) / 10000e0 + CAST(id_entregador AS DOUBLE) / 1e7 END AS latitude,
 CASE WHEN id_entregador % 17 = 16 THEN NULL ELSE CAST(-46.70 AS DOUBLE) + CAST((id_entregador*97) % 1100 AS DOUBLE) / 10000e0 + CAST(id_entregador AS DOUBLE) / 1e7 END AS longitude
 FROM (SELECT DISTINCT user_id + 1 AS id_entregador FROM events) u""",
    ),
    "pedidos": (
        ["orders", "supplier", "events"],
        """SELECT o_orderkey + 1 AS id_pedido, o_custkey + 1 AS id_cliente, o_orderkey % (SELECT count(*) FROM supplier) + 1 AS id_restaurante,
 CASE WHEN st IN ('PICKED_UP','IN_TRANSIT','DELIVERED') THEN o_orderkey % (SELECT count(DISTINCT user_id) FROM events) + 1 END AS id_entregador, st AS status, o_orderdate AS criado_em
 FROM (SELECT o_orderkey, o_custkey, o_orderdate, CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'PICKED_UP' ELSE 'IN_TRANSIT' END
 ELSE CASE o_orderkey % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'PREPARING' ELSE 'READY_FOR_PICKUP' END END AS st FROM orders) o""",
    ),
    # fixed values: the life of an order
    "ciclo": (
        [],
        "SELECT * FROM (VALUES (0,'CONFIRMED'),(1,'PREPARING'),(2,'READY_FOR_PICKUP'),(3,'PICKED_UP'),(4,'IN_TRANSIT'),(5,'DELIVERED')) AS c(passo,status)",
    ),
    # 21 rows: the steps behind an order of each status
    "historia": (
        ["ciclo"],
        "SELECT a.status AS atual, c.passo, c.status FROM ciclo a JOIN ciclo c ON c.passo <= a.passo",
    ),
    "eventos_pedido": (
        ["pedidos", "historia"],
        """SELECT p.id_pedido, p.criado_em + h.passo * INTERVAL '5' MINUTE AS ts, h.status, CASE WHEN h.passo >= 3 THEN p.id_entregador END AS id_entregador
 FROM pedidos p JOIN historia h ON h.atual = p.status""",
    ),
    "telemetria": (
        ["events"],
        """SELECT user_id + 1 AS id_entregador, ts,
 CAST(-23.60 AS DOUBLE) + CAST((event_id*13) % 1100 AS DOUBLE) / 10000e0 + CAST(event_id AS DOUBLE) / 1e7 AS latitude,
 CAST(-46.70 AS DOUBLE) + CAST((event_id*29) % 1100 AS DOUBLE) / 10000e0 + CAST(event_id AS DOUBLE) / 1e7 AS longitude FROM events""",
    ),
    # writes in batches: some events come again, some twice in one batch, with the key and time they had
    "escritas_evento": (
        ["eventos_pedido"],
        """SELECT id_pedido, ts, status, id_entregador, lote, write_seq, substr(md5(concat_ws('|', CAST(id_pedido AS STRING), status, CAST(lote * 10 + write_seq AS STRING))), 1, 8) AS event_id
 FROM (SELECT *, 0 AS lote, 0 AS write_seq FROM eventos_pedido
 UNION ALL SELECT *, 1, 0 FROM eventos_pedido WHERE id_pedido % 3 = 0
 UNION ALL SELECT *, 2, 1 FROM eventos_pedido WHERE id_pedido % 5 = 0
 UNION ALL SELECT *, 2, 0 FROM eventos_pedido WHERE id_pedido % 5 < 2) w""",
    ),
    # positions to the hour, so that a courier has many with the same time
    "escritas_posicao": (
        ["events"],
        """SELECT user_id + 1 AS id_entregador, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, event_id % 4 AS lote, event_id AS write_seq,
 CAST(-23.60 AS DOUBLE) + CAST(event_id AS DOUBLE) / 1e7 AS latitude, CAST(-46.70 AS DOUBLE) + CAST(event_id AS DOUBLE) / 1e7 AS longitude FROM events""",
    ),
    "requisicoes": (
        ["events"],
        """SELECT CASE WHEN day(ts) <= 20 THEN 0 WHEN day(ts) <= 26 THEN 1 ELSE 2 END AS ritmo_idx,
 CASE WHEN event_type IN ('click','view') THEN 'GET' WHEN event_type = 'error' AND day(ts) <= 26 THEN 'PATCH' ELSE 'POST' END AS method,
 CASE WHEN event_type = 'error' THEN 'error' ELSE '200' END AS status, value AS latency
 FROM events""",
    ),
    "alocacoes": (
        ["pedidos"],
        """SELECT p.id_entregador, p.criado_em + INTERVAL '12' MINUTE AS ts, 'ATIVO' AS status, p.id_pedido FROM pedidos p WHERE p.id_entregador IS NOT NULL
 UNION ALL SELECT p.id_entregador, p.criado_em + INTERVAL '26' MINUTE, 'INATIVA', p.id_pedido FROM pedidos p WHERE p.status = 'DELIVERED'""",
    ),
    # every third event asks for the same order, so one order holds a third of all updates
    "atualizacoes": (
        ["events", "pedidos", "ciclo"],
        """SELECT e.event_id AS seq, e.ts, e.id_pedido,
 CASE WHEN e.event_id % 101 = 7 THEN 'CANCELLED' ELSE c.status END AS novo_status,
 CASE WHEN e.event_id % 4 = 3 THEN e.user_id + 1 WHEN e.event_id % 59 = 2 THEN e.user_id + 1000000001 END AS id_entregador
 FROM (SELECT event_id, ts, user_id, event_type,
 CAST(CASE WHEN event_id % 3 = 0 THEN 10 WHEN event_id % 91 = 5 THEN event_id + 1000000001 ELSE (event_id - event_id % 8) / 8 * 11 + 1 END AS BIGINT) AS id_pedido FROM events) e
 LEFT JOIN pedidos p ON p.id_pedido = e.id_pedido
 LEFT JOIN ciclo a ON a.status = p.status
 JOIN ciclo c ON c.passo = (coalesce(a.passo, 0) + e.event_id % 8 - CASE WHEN e.event_type = 'error' THEN 1 ELSE 0 END + 6) % 6""",
    ),
    "novos_pedidos": (
        ["orders", "supplier"],
        """SELECT o_orderkey AS seq, o_orderdate AS ts,
 CASE WHEN o_orderkey % 97 = 5 THEN o_custkey + 1000000001 ELSE o_custkey + 1 END AS id_cliente,
 o_orderkey % ((SELECT count(*) FROM supplier) + 2) + 1 AS id_restaurante, o_orderkey % 40 AS item, o_orderkey % 3 + 1 AS qtd
 FROM orders""",
    ),
}


def needed(names: list[str]) -> list[str]:
    """The views behind ``names``, each after those it reads."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for dependency in VIEWS[name][0]:
                visit(dependency)
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def with_views(names: list[str], body: str, recursive: bool = False, extra: str = "") -> str:
    """``body`` with the needed views as common table expressions (oracle side)."""
    parts = [f"{v} AS (\n{VIEWS[v][1]})" for v in needed(names)]
    if extra:
        parts.append(extra)
    if not parts:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet files; unused columns are pruned at the scan."""
    views = needed([name])
    raw = sorted({d for v in views for d in VIEWS[v][0] if d in RAW})
    parts = [f"{r} AS (SELECT * FROM parquet.`{sf_dir}/{r}.parquet`)" for r in raw]
    parts += [f"{v} AS (\n{VIEWS[v][1]})" for v in views]
    return spark.sql("WITH " + ",\n".join(parts) + f"\nSELECT * FROM {name}")
