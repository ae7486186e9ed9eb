"""The same questions in SQL for the checking engine, each over the whole tables."""

from __future__ import annotations

import re

from frota.plans.queries import AS_OF
from frota.plans.views import with_views


def _haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return f"(6371.0 * (2 * atan2(sqrt({a}), sqrt(1 - {a}))))"


ORACLES: dict[str, str] = {}


def _put(name: str, views: list[str], body: str, extra: str = "", recursive: bool = False) -> None:
    ORACLES[name] = with_views(views, body, recursive, extra)


def _r(column: str, digits: int = 6) -> str:
    return f"round({column}, {digits}) AS {column.split('.')[-1]}"


# ---- sources, sinks, table access

_put(
    "road_graph_roundtrip",
    ["grafo_nos", "grafo_arestas"],
    "SELECT edge_seq, from_node, to_node, CASE WHEN weight = 100 THEN 1.0 ELSE weight END AS weight, node_pos AS from_pos, "
    f"{_r('lat', 9)}, {_r('lon', 9)} FROM grafo_arestas JOIN grafo_nos ON node_id = from_node",
)
_put(
    "road_edges_min",
    ["grafo_arestas"],
    "SELECT from_node, to_node, min(weight) AS weight FROM grafo_arestas WHERE from_node <> to_node GROUP BY from_node, to_node",
)
_put(
    "road_edges_first",
    ["grafo_arestas"],
    "SELECT from_node, to_node, arg_min(weight, edge_seq) AS weight FROM grafo_arestas GROUP BY from_node, to_node",
)
_put(
    "road_edges_rejected",
    ["grafo_arestas", "malha"],
    """SELECT edge_seq, from_node, to_node, weight, CASE WHEN weight < 0 THEN 'PESO' ELSE 'NO_DESCONHECIDO' END AS motivo
FROM (SELECT edge_seq, from_node, to_node, CASE WHEN edge_seq % 13 = 1 THEN -weight ELSE weight END AS weight, n, w FROM grafo_arestas CROSS JOIN malha) e
WHERE weight < 0 OR from_node >= n - w OR to_node >= n - w""",
)
for _view, _key, _columns in [
    ("clientes", "id_cliente", "nome"),
    ("restaurantes", "id_restaurante", "nome"),
    ("entregadores", "id_entregador", "status"),
    ("pedidos", "id_pedido", "id_cliente, id_restaurante, id_entregador, status"),
]:
    _put(
        f"list_{_view}_page",
        [_view],
        f"SELECT {_key}, {_columns} FROM {_view} ORDER BY {_key} LIMIT 10 OFFSET 5",
    )
_put(
    "constraint_violations",
    ["clientes", "restaurantes", "entregadores", "novos_pedidos"],
    """SELECT 'pedidos' AS tabela, 'chave' AS regra, 'id_pedido' AS coluna, id_pedido AS valor, count(*) AS n FROM p GROUP BY id_pedido HAVING count(*) > 1
UNION ALL SELECT 'pedidos', 'referencia', 'id_cliente', id_cliente, count(*) FROM p WHERE id_cliente NOT IN (SELECT id_cliente FROM clientes) GROUP BY id_cliente
UNION ALL SELECT 'pedidos', 'referencia', 'id_restaurante', id_restaurante, count(*) FROM p WHERE id_restaurante NOT IN (SELECT id_restaurante FROM restaurantes) GROUP BY id_restaurante
UNION ALL SELECT 'pedidos', 'referencia', 'id_entregador', id_entregador, count(*) FROM p WHERE id_entregador NOT IN (SELECT id_entregador FROM entregadores) GROUP BY id_entregador""",
    extra="""p AS (SELECT CASE WHEN seq % 50 = 0 THEN seq + 1 ELSE seq END AS id_pedido, id_cliente, id_restaurante,
 id_cliente % 1600 + 1 AS id_entregador FROM novos_pedidos)""",
)
_put(
    "insert_couriers",
    ["entregadores", "clientes"],
    f"""SELECT m + row_number() OVER (ORDER BY id_cliente) AS id_entregador, 'AVAILABLE' AS status, {_r('latitude', 9)}, {_r('longitude', 9)}
FROM clientes CROSS JOIN (SELECT max(id_entregador) AS m FROM entregadores) x""",
)
_INSERTED = "SELECT (SELECT max({0}) FROM {1}) + row_number() OVER (ORDER BY {2}) AS {0}, nome, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude FROM {3}"
_put("insert_customers", ["clientes", "restaurantes"], _INSERTED.format("id_cliente", "clientes", "id_restaurante", "restaurantes"))
_put("insert_restaurants", ["clientes", "restaurantes"], _INSERTED.format("id_restaurante", "restaurantes", "id_cliente", "clientes"))
_put(
    "inserted_counts",
    ["clientes", "restaurantes"],
    "SELECT 'clientes' AS tabela, count(*) AS n FROM restaurantes UNION ALL SELECT 'restaurantes', count(*) FROM clientes",
)
_put(
    "put_latest_allocation",
    ["alocacoes"],
    """SELECT id_entregador, ts, status, id_pedido FROM (SELECT *, row_number() OVER (PARTITION BY id_entregador, ts ORDER BY id_pedido DESC) AS rn FROM alocacoes) a WHERE rn = 1""",
)
for _name, _view, _key, _shown in [
    ("put_latest_event", "escritas_evento", "id_pedido", "id_pedido, ts, status, event_id, id_entregador"),
    ("put_latest_position", "escritas_posicao", "id_entregador", "id_entregador, ts, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude"),
]:
    _put(_name, [_view], f"SELECT {_shown} FROM (SELECT *, row_number() OVER (PARTITION BY {_key}, ts ORDER BY lote DESC, write_seq DESC) AS rn FROM {_view}) w WHERE rn = 1")
for _view, _key in [("clientes", "id_cliente"), ("restaurantes", "id_restaurante"), ("entregadores", "id_entregador"), ("pedidos", "id_pedido")]:
    _places = "" if _view == "pedidos" else " REPLACE (round(latitude, 9) AS latitude, round(longitude, 9) AS longitude)"
    _put(
        f"seek_{_view}_pages",
        [_view],
        f"""SELECT * EXCLUDE (lugar, n){_places} FROM (SELECT *, row_number() OVER (ORDER BY {_key}) - 1 AS lugar, count(*) OVER () AS n FROM {_view}) t
WHERE lugar >= n // 2 AND lugar < n // 2 + 150""",
    )
_put(
    "order_history_lookup",
    ["novos_pedidos", "eventos_pedido"],
    """SELECT k.id_pedido, e.id_pedido IS NOT NULL AS found, CAST(CASE WHEN e.id_pedido IS NOT NULL THEN row_number() OVER (PARTITION BY k.id_pedido ORDER BY e.ts) - 1 END AS INT) AS ordem,
 e.ts, e.status, CASE WHEN e.id_pedido IS NOT NULL THEN substr(md5(concat_ws('|', e.id_pedido, e.status)), 1, 8) END AS event_id, e.id_entregador
FROM (SELECT DISTINCT seq * 2 + 1 AS id_pedido FROM novos_pedidos) k LEFT JOIN eventos_pedido e ON e.id_pedido = k.id_pedido""",
)
_put(
    "order_items_variant",
    ["novos_pedidos"],
    """SELECT seq, texto, texto AS volta, item, item + 0.5::DOUBLE AS preco, qtd AS extra, CASE WHEN qtd = 2 THEN CAST(2 AS BIGINT) END AS tamanho FROM (
 SELECT *, concat('[{"extras":["sal",', qtd, ',{"nota":null}],"item":', item, ',"preco":', item, '.5,"qtd":', qtd, '}', CASE WHEN qtd = 2 THEN ',{"item":{"nome":"x","tamanho":2}}' ELSE '' END, ']') AS texto FROM novos_pedidos) t""",
)
_put(
    "lookup_orders",
    ["novos_pedidos", "pedidos"],
    """SELECT k.id_pedido, p.id_cliente, p.status, p.id_pedido IS NOT NULL AS found
FROM (SELECT DISTINCT seq * 2 + 1 AS id_pedido FROM novos_pedidos) k LEFT JOIN pedidos p ON p.id_pedido = k.id_pedido""",
)

# ---- scalar functions

_PLACES = """FROM pedidos p JOIN restaurantes r ON r.id_restaurante = p.id_restaurante JOIN clientes c ON c.id_cliente = p.id_cliente"""
_put(
    "haversine_distance",
    ["pedidos", "restaurantes", "clientes"],
    f"SELECT id_pedido, round({_haversine('r.latitude', 'r.longitude', 'c.latitude', 'c.longitude')}, 6) AS dist_km {_PLACES}",
)
_put(
    "iso_timestamps",
    ["telemetria"],
    """SELECT id_entregador, CASE WHEN strftime(ts, '%f') = '000000' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS texto, ts FROM telemetria""",
)
_put(
    "decimal_routes",
    ["grafo_arestas", "grafo_nos"],
    """SELECT edge_seq, round(a.lat, 6) AS from_lat, round(a.lon, 6) AS from_lon, round(b.lat, 6) AS to_lat, round(b.lon, 6) AS to_lon, weight
FROM grafo_arestas JOIN grafo_nos a ON a.node_id = from_node JOIN grafo_nos b ON b.node_id = to_node""",
)
_put("coordinates_as_text", ["telemetria"], "SELECT id_entregador, ts, latitude, longitude FROM telemetria")
_put(
    "order_items_json",
    ["novos_pedidos"],
    """SELECT seq, '[{"item":' || item || ',"qtd":' || qtd || '}]' AS lista_itens, item, qtd FROM novos_pedidos""",
)
_put(
    "id_text",
    ["eventos_pedido"],
    """SELECT id_pedido, status, CASE WHEN id_entregador IS NOT NULL THEN CAST(id_entregador AS VARCHAR) WHEN status = 'CONFIRMED' THEN 'None'
 WHEN status = 'PREPARING' THEN '' END AS texto, id_entregador FROM eventos_pedido""",
)
_put(
    "event_short_ids",
    ["eventos_pedido"],
    "SELECT id_pedido, status, substr(md5(concat_ws('|', id_pedido, status)), 1, 8) AS event_id FROM eventos_pedido",
)
_put(
    "status_domain_rejects",
    ["atualizacoes", "ciclo"],
    "SELECT seq, id_pedido, novo_status FROM atualizacoes WHERE novo_status NOT IN (SELECT status FROM ciclo)",
)

# ---- filters, sorted reads

_WAITING = "status IN ('PREPARING','READY_FOR_PICKUP') AND id_entregador IS NULL"
_FREE = "status = 'AVAILABLE' AND latitude IS NOT NULL AND longitude IS NOT NULL"
_put("waiting_orders", ["pedidos"], f"SELECT id_pedido, id_restaurante, status FROM pedidos WHERE {_WAITING}")
_put(
    "available_couriers",
    ["entregadores"],
    f"SELECT id_entregador, {_r('latitude', 9)}, {_r('longitude', 9)} FROM entregadores WHERE {_FREE}",
)
_put(
    "order_history",
    ["eventos_pedido"],
    "SELECT id_pedido, ts, status, id_entregador FROM eventos_pedido ORDER BY id_pedido, ts",
)
_put(
    "customer_orders",
    ["novos_pedidos", "clientes", "pedidos"],
    """SELECT k.id_cliente, c.id_cliente IS NOT NULL AS found, CASE WHEN c.id_cliente IS NOT NULL THEN p.id_pedido END AS id_pedido,
 CASE WHEN c.id_cliente IS NOT NULL THEN p.status END AS status
FROM (SELECT DISTINCT id_cliente FROM novos_pedidos) k LEFT JOIN clientes c ON c.id_cliente = k.id_cliente LEFT JOIN pedidos p ON p.id_cliente = k.id_cliente
ORDER BY 1, 3""",
)
_CURRENT = """atual AS (SELECT id_entregador, CASE WHEN status IN ('ATIVO','ATIVA') THEN id_pedido END AS id_pedido
 FROM (SELECT *, row_number() OVER (PARTITION BY id_entregador ORDER BY ts DESC, id_pedido DESC) AS rn FROM alocacoes) a WHERE rn = 1)"""
_put("current_allocation", ["alocacoes"], "SELECT * FROM atual", extra=_CURRENT)
_put(
    "open_orders_by_status",
    ["pedidos"],
    "SELECT status, count(*) AS n_pedidos FROM pedidos WHERE status IN ('CONFIRMED','PREPARING') GROUP BY status",
)

# ---- joins

_put(
    "order_positions",
    ["pedidos", "restaurantes", "clientes"],
    f"""SELECT id_pedido, round(r.latitude, 9) AS rest_lat, round(r.longitude, 9) AS rest_lon,
 round(c.latitude, 9) AS cli_lat, round(c.longitude, 9) AS cli_lon {_PLACES}""",
)
_put(
    "rejected_new_orders",
    ["novos_pedidos", "clientes", "restaurantes"],
    """SELECT seq, n.id_cliente, n.id_restaurante, CASE WHEN c.id_cliente IS NULL THEN 'CLIENTE_NAO_ENCONTRADO' ELSE 'RESTAURANTE_NAO_ENCONTRADO' END AS motivo
FROM novos_pedidos n LEFT JOIN clientes c ON c.id_cliente = n.id_cliente LEFT JOIN restaurantes r ON r.id_restaurante = n.id_restaurante
WHERE c.id_cliente IS NULL OR r.id_restaurante IS NULL""",
)


def _tracked(where: str) -> tuple[str, str]:
    extra = f"""ult_ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_pedido ORDER BY ts DESC) AS rn FROM eventos_pedido {where}) e WHERE rn = 1),
ult_pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_entregador ORDER BY ts DESC) AS rn FROM telemetria {where}) t WHERE rn = 1)"""
    body = """SELECT e.id_pedido, e.status, e.id_entregador, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude, t.ts AS ultima_atualizacao
FROM ult_ev e LEFT JOIN ult_pos t ON t.id_entregador = e.id_entregador"""
    return body, extra


_put("track_orders", ["eventos_pedido", "telemetria"], *_tracked(""))
_put("track_orders_as_of", ["eventos_pedido", "telemetria"], *_tracked(f"WHERE ts <= TIMESTAMP '{AS_OF}'"))


def _snap(name: str, view: str, key: str, where: str = "latitude IS NOT NULL AND longitude IS NOT NULL") -> str:
    d = _haversine("latitude", "longitude", "lat", "lon")
    return f"{name} AS (SELECT {key}, arg_min(node_id, {d}) AS node FROM {view} CROSS JOIN grafo_nos WHERE {where} GROUP BY {key})"


_put(
    "nearest_node_restaurants",
    ["restaurantes", "grafo_nos"],
    "SELECT id_restaurante, node AS node_id FROM sr",
    _snap("sr", "restaurantes", "id_restaurante"),
)
_put(
    "nearest_node_customers",
    ["clientes", "grafo_nos"],
    "SELECT id_cliente, node AS node_id FROM sc",
    _snap("sc", "clientes", "id_cliente"),
)
_NEAR = f"""perto AS (SELECT id_restaurante, id_entregador, dist_km, row_number() OVER (PARTITION BY id_restaurante ORDER BY dist_km, id_entregador) AS rank
 FROM (SELECT id_restaurante, id_entregador, {_haversine('r.latitude', 'r.longitude', 'e.latitude', 'e.longitude')} AS dist_km
 FROM restaurantes r CROSS JOIN entregadores e WHERE e.status = 'AVAILABLE' AND e.latitude IS NOT NULL AND e.longitude IS NOT NULL) x)"""
_put(
    "nearest_couriers_top3",
    ["pedidos", "restaurantes", "entregadores"],
    f"""SELECT id_pedido, id_entregador, round(dist_km, 6) AS dist_km, rank FROM pedidos p JOIN perto n ON n.id_restaurante = p.id_restaurante
WHERE {_WAITING.replace('id_entregador', 'p.id_entregador')} AND rank <= 3""".replace("SELECT id_pedido, id_entregador", "SELECT id_pedido, n.id_entregador"),
    _NEAR,
)
_put(
    "idle_customers",
    ["clientes", "pedidos"],
    "SELECT id_cliente FROM clientes WHERE id_cliente NOT IN (SELECT id_cliente FROM pedidos WHERE status <> 'DELIVERED')",
)
_put(
    "newly_allocated_couriers",
    ["alocacoes", "entregadores"],
    f"SELECT id_entregador, id_pedido FROM atual WHERE id_pedido IS NOT NULL AND id_entregador IN (SELECT id_entregador FROM entregadores WHERE {_FREE})",
    _CURRENT,
)

# ---- aggregates

_put("latest_events", ["eventos_pedido", "telemetria"], "SELECT id_pedido, ts, status, id_entregador FROM ult_ev", _tracked("")[1])
_put(
    "latest_positions",
    ["eventos_pedido", "telemetria"],
    f"SELECT id_entregador, ts, {_r('latitude', 9)}, {_r('longitude', 9)} FROM ult_pos",
    _tracked("")[1],
)


def _report(where: str, digits: str) -> tuple[str, str]:
    extra = f"""fases AS (SELECT * FROM (VALUES (0,'OPERACAO_NORMAL'),(1,'PICO'),(2,'EVENTO_ESPECIAL')) AS f(ritmo_idx, volume)),
metodos AS (SELECT * FROM (VALUES ('PATCH'),('POST'),('GET')) AS m(method)),
m AS (SELECT ritmo_idx, method, count(*) AS n, min(latency) AS mn, avg(latency) AS av, median(latency) AS md, max(latency) AS mx,
 list_sort(list(latency)) AS l FROM requisicoes {where} GROUP BY ritmo_idx, method)"""
    body = """SELECT f.ritmo_idx, volume, t.method, coalesce(n, 0) AS n, {0} FROM fases f CROSS JOIN metodos t
LEFT JOIN m ON m.ritmo_idx = f.ritmo_idx AND m.method = t.method"""
    columns = {"min": "mn", "mean": "av", "median": "md", "p95": "l[least((n * 95) // 100, n - 1) + 1]", "max": "mx"}
    shown = {k: f"{v} AS {k}" for k, v in columns.items()}
    if digits == "mean":
        shown["mean"] = "round(av, 6) AS mean"
    else:
        shown = {k: f"round_even({v}, 4) AS {k}" for k, v in columns.items()}
    return body.format(", ".join(shown.values())), extra


_put("latency_report", ["requisicoes"], *_report("", "mean"))
_put("latency_report_display", ["requisicoes"], *_report("", "all"))
ORACLES["latency_report_narrowed"] = ORACLES["latency_report"]
_put("total_requests", ["requisicoes"], "SELECT count(*) AS total FROM requisicoes")

# ---- graph

_MIN = "leves AS (SELECT from_node, to_node, min(weight) AS weight FROM grafo_arestas WHERE from_node <> to_node GROUP BY from_node, to_node)"


def _dist(name: str, starts: str) -> str:
    """All distances from the nodes that ``starts`` selects."""
    return f"""{name} (source, node, d) USING KEY (source, node) AS (SELECT DISTINCT s, s, 0.0::DOUBLE FROM ({starts}) q
 UNION SELECT p.source, e.to_node, min(p.d + e.weight) FROM {name} p JOIN leves e ON e.from_node = p.node
 LEFT JOIN recurring.{name} r ON r.source = p.source AND r.node = e.to_node
 GROUP BY p.source, e.to_node, r.d HAVING r.d IS NULL OR min(p.d + e.weight) < r.d)"""


_SR = _snap("sr", "restaurantes", "id_restaurante")
_SC = _snap("sc", "clientes", "id_cliente")
_SE = _snap("se", "entregadores", "id_entregador")
_PAIRS = f"""pares AS (SELECT DISTINCT sr.node AS source, sc.node AS target FROM pedidos p JOIN sr ON sr.id_restaurante = p.id_restaurante
 JOIN sc ON sc.id_cliente = p.id_cliente WHERE {_WAITING})"""
_GRAPH = ["pedidos", "restaurantes", "clientes", "grafo_nos", "grafo_arestas"]
_put(
    "shortest_distances",
    _GRAPH,
    "SELECT d.source, d.node, d.d FROM dist d JOIN pares p ON p.source = d.source AND p.target = d.node",
    ",\n".join([_MIN, _SR, _SC, _PAIRS, _dist("dist", "SELECT source AS s FROM pares")]),
    recursive=True,
)
_put(
    "unreachable_pairs",
    _GRAPH,
    "SELECT p.source, p.target FROM pares p LEFT JOIN dist d ON d.source = p.source AND d.node = p.target WHERE d.d IS NULL",
    ",\n".join([_MIN, _SR, _SC, _PAIRS, _dist("dist", "SELECT source AS s FROM pares")]),
    recursive=True,
)
_PATHS = """ant AS (SELECT a.source, e.to_node AS node, arg_min(a.node, row(a.d, a.node)) AS prev FROM dist a JOIN leves e ON e.from_node = a.node
 JOIN dist b ON b.source = a.source AND b.node = e.to_node WHERE a.d + e.weight = b.d GROUP BY a.source, e.to_node),
volta AS (SELECT p.source, p.target, p.target AS node, 0 AS back FROM pares p JOIN dist d ON d.source = p.source AND d.node = p.target
 UNION ALL SELECT v.source, v.target, a.prev, v.back + 1 FROM volta v JOIN ant a ON a.source = v.source AND a.node = v.node),
caminhos AS (SELECT source, target, CAST(max(back) OVER (PARTITION BY source, target) - back AS INT) AS pos, node FROM volta)"""
_HOPS = """primeiras AS (SELECT from_node, to_node, arg_min(weight, edge_seq) AS weight FROM grafo_arestas GROUP BY from_node, to_node),
trechos AS (SELECT c.source, c.target, c.pos AS hop, c.node AS from_node, n.node AS to_node, a.lat AS from_lat, a.lon AS from_lon, b.lat AS to_lat, b.lon AS to_lon, w.weight
 FROM caminhos c JOIN caminhos n ON n.source = c.source AND n.target = c.target AND n.pos = c.pos + 1
 JOIN grafo_nos a ON a.node_id = c.node JOIN grafo_nos b ON b.node_id = n.node JOIN primeiras w ON w.from_node = c.node AND w.to_node = n.node)"""
_HOP = f"hop, from_node, to_node, {_r('from_lat')}, {_r('from_lon')}, {_r('to_lat')}, {_r('to_lon')}, weight"
_FROM_PAIRS = _dist("dist", "SELECT source AS s FROM pares")
_put(
    "paths",
    _GRAPH,
    "SELECT source, target, pos, node FROM caminhos",
    ",\n".join([_MIN, _SR, _SC, _PAIRS, _FROM_PAIRS, _PATHS]),
    recursive=True,
)
_put(
    "delivery_routes",
    _GRAPH,
    f"SELECT source, target, {_HOP} FROM trechos",
    ",\n".join([_MIN, _SR, _SC, _PAIRS, _FROM_PAIRS, _PATHS, _HOPS]),
    recursive=True,
)
ORACLES["road_paths_shuffled"] = ORACLES["paths"]
ORACLES["road_distances_regions"] = ORACLES["shortest_distances"]

# ---- state machine

_JUDGED = """fila AS (SELECT u.seq, u.ts, u.id_pedido, u.novo_status, u.id_entregador, n.passo AS pedido_passo, a.passo AS passo0, p.id_entregador AS courier0,
 u.id_entregador IS NULL OR u.id_entregador IN (SELECT id_entregador FROM entregadores) AS courier_ok, row_number() OVER (PARTITION BY u.id_pedido ORDER BY u.seq) AS vez
 FROM atualizacoes u LEFT JOIN pedidos p ON p.id_pedido = u.id_pedido LEFT JOIN ciclo a ON a.status = p.status LEFT JOIN ciclo n ON n.status = u.novo_status),
dobra AS (SELECT *, passo0 AS passo, courier0 AS courier, CAST(NULL AS VARCHAR) AS resultado FROM (SELECT DISTINCT CAST(-1 AS BIGINT) AS seq, CAST(NULL AS TIMESTAMP) AS ts,
 id_pedido, CAST(NULL AS VARCHAR) AS novo_status, CAST(NULL AS BIGINT) AS id_entregador, CAST(NULL AS INTEGER) AS pedido_passo, passo0, courier0, true AS courier_ok, CAST(0 AS BIGINT) AS vez FROM fila) i
 UNION ALL SELECT seq, ts, id_pedido, novo_status, id_entregador, pedido_passo, passo0, courier0, courier_ok, vez,
 CASE WHEN r = 'OK' THEN pedido_passo ELSE passo END, CASE WHEN r = 'OK' THEN coalesce(id_entregador, courier) ELSE courier END, r
 FROM (SELECT f.*, d.passo, d.courier, CASE WHEN f.pedido_passo IS NULL THEN 'INVALID_STATUS' WHEN f.passo0 IS NULL THEN 'NOT_FOUND'
 WHEN f.pedido_passo >= 3 AND coalesce(f.id_entregador, d.courier) IS NULL THEN 'NO_COURIER' WHEN f.pedido_passo <> d.passo + 1 THEN 'BAD_TRANSITION'
 WHEN NOT f.courier_ok THEN 'UNKNOWN_COURIER' ELSE 'OK' END AS r FROM dobra d JOIN fila f ON f.id_pedido = d.id_pedido AND f.vez = d.vez + 1) x),
julgado AS (SELECT seq, ts, id_pedido, novo_status, id_entregador, resultado, CASE WHEN resultado = 'OK' THEN courier END AS courier_evento, passo, courier, vez FROM dobra)"""
_STATE = ["pedidos", "entregadores", "atualizacoes", "ciclo"]
_OUTCOME = "SELECT seq, id_pedido, novo_status, id_entregador, resultado, courier_evento FROM julgado WHERE vez > 0"
_put("apply_status_updates", _STATE, _OUTCOME, _JUDGED, recursive=True)
_put("stream_status", _STATE, _OUTCOME, _JUDGED, recursive=True)
_put(
    "accepted_status_events",
    _STATE,
    """SELECT id_pedido, ts, novo_status AS status, substr(md5(concat_ws('|', id_pedido, seq)), 1, 8) AS event_id, courier_evento AS id_entregador
FROM julgado WHERE resultado = 'OK'""",
    _JUDGED,
    recursive=True,
)
_put(
    "orders_after_updates",
    _STATE,
    """SELECT p.id_pedido, coalesce(u.novo_status, p.status) AS status, coalesce(u.courier_evento, p.id_entregador) AS id_entregador FROM pedidos p
LEFT JOIN (SELECT id_pedido, arg_max(novo_status, seq) AS novo_status, max_by(courier, seq) AS courier_evento FROM julgado WHERE resultado = 'OK' GROUP BY id_pedido) u ON u.id_pedido = p.id_pedido""",
    _JUDGED,
    recursive=True,
)
_put(
    "stream_tracking",
    [*_STATE, "eventos_pedido", "telemetria"],
    """SELECT h.id_pedido, CASE WHEN e.id_pedido IS NULL THEN h.status ELSE e.status END AS status,
 CASE WHEN e.id_pedido IS NULL THEN h.id_entregador ELSE e.id_entregador END AS id_entregador, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude, t.ts AS ultima_atualizacao
FROM ult_ev h LEFT JOIN (SELECT id_pedido, novo_status AS status, courier_evento AS id_entregador, row_number() OVER (PARTITION BY id_pedido ORDER BY seq DESC) AS k FROM julgado WHERE resultado = 'OK') e
 ON e.id_pedido = h.id_pedido AND e.k = 1
LEFT JOIN ult_pos t ON t.id_entregador = CASE WHEN e.id_pedido IS NULL THEN h.id_entregador ELSE e.id_entregador END""",
    _JUDGED + ",\n" + _tracked("")[1],
    recursive=True,
)
ORACLES["stream_positions"] = ORACLES["latest_positions"]

# ---- dispatch

_LIVRES = [
    _MIN,
    _SR,
    _SC,
    _snap("se", "entregadores", "id_entregador", _FREE),
    _dist("dist", "SELECT node AS s FROM se"),
    _NEAR,
    """opcoes AS (SELECT n.id_restaurante, n.id_entregador, n.rank, d.d FROM perto n JOIN sr ON sr.id_restaurante = n.id_restaurante
 JOIN se ON se.id_entregador = n.id_entregador LEFT JOIN dist d ON d.source = se.node AND d.node = sr.node)""",
]
_DISPATCH = ["pedidos", "restaurantes", "clientes", "entregadores", "grafo_nos", "grafo_arestas"]
_put(
    "best_courier_by_road",
    _DISPATCH,
    f"""SELECT p.id_pedido, b.id_entregador, b.road_dist FROM pedidos p LEFT JOIN (SELECT id_restaurante, arg_min(id_entregador, row(d, rank)) AS id_entregador, min(d) AS road_dist
FROM opcoes WHERE rank <= 3 AND d IS NOT NULL GROUP BY id_restaurante) b ON b.id_restaurante = p.id_restaurante WHERE {_WAITING.replace('id_entregador', 'p.id_entregador')}""",
    ",\n".join(_LIVRES),
    recursive=True,
)
# one waiting order per step, carrying the couriers taken so far, until none is free
_SERIAL = f"""espera AS (SELECT id_pedido, id_restaurante, id_cliente, row_number() OVER (ORDER BY id_pedido) AS vez FROM pedidos WHERE {_WAITING}),
serie AS (SELECT CAST(0 AS BIGINT) AS vez, CAST([] AS BIGINT[]) AS tomados, CAST(NULL AS BIGINT) AS id_entregador, CAST(NULL AS DOUBLE) AS road_dist, CAST(0 AS BIGINT) AS vistos
 UNION ALL SELECT vez, CASE WHEN e IS NULL THEN tomados ELSE list_append(tomados, e) END, e, road, vistos
 FROM (SELECT t.vez, t.tomados, arg_min(t.id_entregador, row(t.d, t.rank)) FILTER (WHERE t.d IS NOT NULL) AS e, min(t.d) AS road, count(*) AS vistos
 FROM (SELECT w.vez, s.tomados, o.id_entregador, o.rank, o.d, row_number() OVER (ORDER BY o.rank) AS k FROM serie s JOIN espera w ON w.vez = s.vez + 1
 JOIN opcoes o ON o.id_restaurante = w.id_restaurante WHERE NOT list_contains(s.tomados, o.id_entregador)) t WHERE t.k <= 3 GROUP BY t.vez, t.tomados) y),
despacho AS (SELECT w.id_pedido, w.id_restaurante, w.id_cliente, s.id_entregador, s.road_dist,
 CASE WHEN s.id_entregador IS NOT NULL THEN NULL WHEN s.vez IS NULL THEN 'NO_COURIER' ELSE 'NO_PATH' END AS motivo FROM espera w LEFT JOIN serie s ON s.vez = w.vez)"""
_ASSIGNED = "SELECT id_pedido, id_entregador, road_dist, motivo FROM despacho"
_put("dispatch", _DISPATCH, _ASSIGNED, ",\n".join([*_LIVRES, _SERIAL]), recursive=True)
ORACLES["dispatch_zoned"] = ORACLES["dispatch"]
_put("stream_dispatch", _DISPATCH, _ASSIGNED, ",\n".join([*_LIVRES, _SERIAL]), recursive=True)
_LEGS = """pernas AS (SELECT x.id_pedido, x.id_entregador, 1 AS perna, se.node AS source, sr.node AS target FROM despacho x JOIN se ON se.id_entregador = x.id_entregador
 JOIN sr ON sr.id_restaurante = x.id_restaurante
 UNION ALL SELECT x.id_pedido, x.id_entregador, 2, sr.node, sc.node FROM despacho x JOIN sr ON sr.id_restaurante = x.id_restaurante
 JOIN sc ON sc.id_cliente = x.id_cliente WHERE x.id_entregador IS NOT NULL),
pares AS (SELECT DISTINCT source, target FROM pernas)"""
_put(
    "dispatch_routes",
    _DISPATCH,
    f"SELECT id_pedido, id_entregador, perna, {_HOP} FROM pernas p JOIN trechos t ON t.source = p.source AND t.target = p.target",
    ",\n".join([*_LIVRES, _SERIAL, _LEGS, _dist("dist2", "SELECT source AS s FROM pares"), _PATHS.replace("dist ", "dist2 "), _HOPS]),
    recursive=True,
)

_ROUTED = ",\n".join([*_LIVRES, _SERIAL, _LEGS, _dist("dist2", "SELECT source AS s FROM pares"), _PATHS.replace("dist ", "dist2 "), _HOPS])
_put(
    "current_allocation_routes",
    _DISPATCH,
    f"SELECT id_pedido, id_entregador, perna, hop, {_r('from_lat')}, {_r('from_lon')}, {_r('to_lat')}, {_r('to_lon')}, weight "
    "FROM pernas p JOIN trechos t ON t.source = p.source AND t.target = p.target",
    _ROUTED,
    recursive=True,
)
_put(
    "dispatch_allocations",
    _DISPATCH,
    """SELECT p.id_pedido, max(p.id_entregador) AS id_entregador, 'ATIVO' AS status, CAST(count(t.hop) FILTER (WHERE perna = 1) AS INT) AS n_restaurante,
 CAST(count(t.hop) FILTER (WHERE perna = 2) AS INT) AS n_cliente, bool_or(perna = 2 AND t.hop IS NULL AND p.source <> p.target) AS cliente_sem_rota
FROM pernas p LEFT JOIN trechos t ON t.source = p.source AND t.target = p.target WHERE p.id_entregador IS NOT NULL GROUP BY p.id_pedido""",
    _ROUTED,
    recursive=True,
)

# ---- release and new orders

_put(
    "release_couriers",
    ["alocacoes", "entregadores", "pedidos", "clientes"],
    """SELECT e.id_entregador, CASE WHEN u.id_entregador IS NOT NULL THEN 'AVAILABLE' ELSE e.status END AS status,
 round(coalesce(u.latitude, e.latitude), 9) AS latitude, round(coalesce(u.longitude, e.longitude), 9) AS longitude
FROM entregadores e LEFT JOIN (SELECT a.id_entregador, c.latitude, c.longitude, row_number() OVER (PARTITION BY a.id_entregador ORDER BY a.ts DESC, a.id_pedido DESC) AS k
 FROM alocacoes a JOIN pedidos p ON p.id_pedido = a.id_pedido LEFT JOIN clientes c ON c.id_cliente = p.id_cliente WHERE a.status = 'INATIVA') u
ON u.id_entregador = e.id_entregador AND u.k = 1""",
)
_put(
    "release_allocations",
    ["alocacoes"],
    """SELECT a.id_entregador, a.ts, 'INATIVA' AS status, a.id_pedido, EXISTS (SELECT 1 FROM alocacoes b WHERE b.status IN ('ATIVO','ATIVA')
 AND b.id_entregador = a.id_entregador AND b.id_pedido = a.id_pedido) AS matched_allocation FROM alocacoes a WHERE a.status = 'INATIVA'""",
)
_NEW = """novos AS (SELECT m + row_number() OVER (ORDER BY seq) AS id_pedido, n.id_cliente, n.id_restaurante, item, qtd, ts FROM novos_pedidos n
 JOIN clientes c ON c.id_cliente = n.id_cliente JOIN restaurantes r ON r.id_restaurante = n.id_restaurante CROSS JOIN (SELECT max(id_pedido) AS m FROM pedidos) x)"""
_put(
    "new_orders",
    ["novos_pedidos", "clientes", "restaurantes", "pedidos"],
    """SELECT id_pedido, id_cliente, id_restaurante, CAST(NULL AS BIGINT) AS id_entregador, '[{"item":' || item || ',"qtd":' || qtd || '}]' AS lista_itens,
 'CONFIRMED' AS status FROM novos""",
    _NEW,
)
_put(
    "new_order_events",
    ["novos_pedidos", "clientes", "restaurantes", "pedidos"],
    """SELECT id_pedido, ts, 'CONFIRMED' AS status, substr(md5(concat_ws('|', id_pedido, 'CONFIRMED')), 1, 8) AS event_id, CAST(NULL AS BIGINT) AS id_entregador FROM novos""",
    _NEW,
)

# ---- the fleet over two triggers


def _again(text: str) -> str:
    """The same tables after the first trigger."""
    return re.sub(r"\b(pedidos|entregadores|se|dist|perto|opcoes|espera|serie|despacho)\b", r"\g<1>_b", text)


_AFTER = """pedidos_b AS (SELECT p.id_pedido, p.id_cliente, p.id_restaurante, coalesce(d.id_entregador, p.id_entregador) AS id_entregador,
 CASE WHEN d.id_entregador IS NOT NULL THEN 'DELIVERED' ELSE p.status END AS status FROM pedidos p LEFT JOIN despacho d ON d.id_pedido = p.id_pedido
 UNION ALL SELECT id_pedido, id_cliente, id_restaurante, NULL, CASE WHEN id_pedido % 3 = 0 THEN 'PREPARING' ELSE 'CONFIRMED' END FROM novos),
entregadores_b AS (SELECT e.id_entregador, CASE WHEN d.id_pedido IS NOT NULL THEN 'AVAILABLE' ELSE e.status END AS status,
 CASE WHEN d.id_pedido IS NOT NULL THEN c.latitude ELSE e.latitude END AS latitude, CASE WHEN d.id_pedido IS NOT NULL THEN c.longitude ELSE e.longitude END AS longitude
 FROM entregadores e LEFT JOIN despacho d ON d.id_entregador = e.id_entregador LEFT JOIN clientes c ON c.id_cliente = d.id_cliente)"""
_put(
    "stream_fleet",
    [*_DISPATCH, "novos_pedidos", "alocacoes"],
    """SELECT 'pedido' AS tabela, p.id_pedido AS chave, p.status, coalesce(d.id_entregador, p.id_entregador) AS outro FROM pedidos_b p LEFT JOIN despacho_b d ON d.id_pedido = p.id_pedido
UNION ALL SELECT 'entregador', e.id_entregador, CASE WHEN d.id_pedido IS NOT NULL THEN 'BUSY' ELSE e.status END, NULL FROM entregadores_b e LEFT JOIN despacho_b d ON d.id_entregador = e.id_entregador
UNION ALL SELECT 'alocacao', id_entregador, status, id_pedido FROM (SELECT *, row_number() OVER (PARTITION BY id_entregador, ts ORDER BY id_pedido DESC) AS rn FROM alocacoes) a WHERE rn = 1
UNION ALL SELECT 'alocacao', id_entregador, 'ATIVO', id_pedido FROM despacho WHERE id_entregador IS NOT NULL
UNION ALL SELECT 'alocacao', id_entregador, 'INATIVA', id_pedido FROM despacho WHERE id_entregador IS NOT NULL
UNION ALL SELECT 'alocacao', id_entregador, 'ATIVO', id_pedido FROM despacho_b WHERE id_entregador IS NOT NULL""",
    ",\n".join([*_LIVRES, _SERIAL, _NEW, _AFTER, *[_again(part) for part in [*_LIVRES[3:], _SERIAL]]]),
    recursive=True,
)
