"""Every registered query: (spark, sf_dir) -> DataFrame over the whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from frota.functions import scalars
from frota.functions.geo import haversine_km
from frota.functions.status import LIFECYCLE, in_domain, status_at, step_of
from frota.operators import dispatch as dp
from frota.operators import graph, nearest, orders as order_ops, reads, report, routes, tracking
from frota.plans.views import table
from frota.session import cut_lineage, work_path
from frota.sources import paging, road_graph, schemas, tables
from frota.sources.snapshots import Snapshots
from frota.streaming import fleet, positions as live_positions
from frota.streaming.tracking import live_tracking

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ALLOCATED_AT = "2100-01-01 00:00:00"
AS_OF = "2024-01-15 00:00:00"


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _nodes(spark: SparkSession, d: str) -> nearest.NearestIndex:
    return nearest.node_index(table(spark, d, "grafo_nos"))


def _r(column: str, digits: int = 6) -> str:
    return f"round({column}, {digits}) AS {column}"


# ---- sources, sinks, table access


@query
def road_graph_roundtrip(spark, d):
    nodes, edges = table(spark, d, "grafo_nos"), table(spark, d, "grafo_arestas")
    folder = work_path(spark, "graph")
    sized = road_graph.edges_with_length(edges.selectExpr("edge_seq", "from_node", "to_node", "nullif(weight, 100D) AS length"))
    road_graph.write_graph(nodes, sized, f"{folder}/nodes", f"{folder}/edges")
    read_nodes = road_graph.read_nodes(spark, f"{folder}/nodes").selectExpr("node_id AS node_id", "node_pos", "lat", "lon")
    read_edges = road_graph.read_edges(spark, f"{folder}/edges")
    return read_edges.join(read_nodes, read_edges["from_node"] == read_nodes["node_id"]).selectExpr(
        "edge_seq", "from_node", "to_node", "weight", "node_pos AS from_pos", _r("lat", 9), _r("lon", 9)
    )


@query
def road_edges_min(spark, d):
    return graph.relax_edges(table(spark, d, "grafo_arestas"))


@query
def road_edges_first(spark, d):
    return graph.first_edges(table(spark, d, "grafo_arestas"))


@query
def road_edges_rejected(spark, d):
    """Edges of a file whose last crossings are not in the node file."""
    grid = table(spark, d, "malha").first()
    nodes = table(spark, d, "grafo_nos").where(F.col("node_id") < grid.n - grid.w)
    edges = table(spark, d, "grafo_arestas").selectExpr(
        "edge_seq", "from_node", "to_node", "CASE WHEN edge_seq % 13 = 1 THEN -weight ELSE weight END AS weight"
    )
    return graph.roads(edges, nodes).rejected


def _roads(spark: SparkSession, d: str, **options) -> graph.Roads:
    return graph.roads(table(spark, d, "grafo_arestas"), table(spark, d, "grafo_nos"), **options)


def _page(view: str, key: str, columns: list[str]) -> None:
    def run(spark, d):
        return tables.page(table(spark, d, view).select(key, *columns), key, offset=5, limit=10)

    REGISTRY[f"list_{view}_page"] = run


_page("clientes", "id_cliente", ["nome"])
_page("restaurantes", "id_restaurante", ["nome"])
_page("entregadores", "id_entregador", ["status"])
_page("pedidos", "id_pedido", ["id_cliente", "id_restaurante", "id_entregador", "status"])


@query
def constraint_violations(spark, d):
    """Order requests loaded without checks: repeated ids and unknown references."""
    loaded = table(spark, d, "novos_pedidos").selectExpr(
        "CASE WHEN seq % 50 = 0 THEN seq + 1 ELSE seq END AS id_pedido",
        "id_cliente",
        "id_restaurante",
        "id_cliente % 1600 + 1 AS id_entregador",
    )
    return schemas.constraint_violations(
        {name: table(spark, d, name) for name in ("clientes", "restaurantes", "entregadores")} | {"pedidos": loaded}
    )


@query
def insert_couriers(spark, d):
    couriers = table(spark, d, "entregadores")
    rows = table(spark, d, "clientes").select("id_cliente", "latitude", "longitude")
    return tables.insert_rows(couriers, rows, "entregadores", ["id_cliente"]).selectExpr(
        "id_entregador", "status", _r("latitude", 9), _r("longitude", 9)
    )


def _inserted(spark, d, name: str, source: str) -> DataFrame:
    rows = table(spark, d, source).select(schemas.KEYS[source], "nome", "latitude", "longitude")
    return tables.insert_rows(table(spark, d, name), rows, name, [schemas.KEYS[source]])


@query
def insert_customers(spark, d):
    return _inserted(spark, d, "clientes", "restaurantes").selectExpr("id_cliente", "nome", _r("latitude", 9), _r("longitude", 9))


@query
def insert_restaurants(spark, d):
    return _inserted(spark, d, "restaurantes", "clientes").selectExpr("id_restaurante", "nome", _r("latitude", 9), _r("longitude", 9))


@query
def inserted_counts(spark, d):
    """How many rows each insert stores."""
    made = {"clientes": "restaurantes", "restaurantes": "clientes"}
    counts = [_inserted(spark, d, n, s).agg(F.lit(n).alias("tabela"), F.count("*").alias("n")) for n, s in made.items()]
    return counts[0].unionByName(counts[1])


@query
def put_latest_allocation(spark, d):
    return tables.put_by_key(table(spark, d, "alocacoes"), "id_entregador", "ts", "id_pedido")


def _put_in_batches(spark, d, name: str, view: str, columns: str) -> DataFrame:
    """Batches of writes appended one after the other, folded on the way."""
    state = Snapshots(spark, work_path(spark, "puts"), {name: fleet.TABLES[name]}, fold_every=2)
    writes = table(spark, d, view).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for version, row in enumerate(writes.select("lote").distinct().orderBy("lote").collect()):
        batch = state.begin(version)
        batch.put(name, writes.where(F.col("lote") == row.lote), "write_seq")
        batch.commit()
    return state.read(name).selectExpr(*columns.split(", "))


@query
def put_latest_event(spark, d):
    return _put_in_batches(spark, d, "eventos", "escritas_evento", "id_pedido, ts, status, event_id, id_entregador")


@query
def put_latest_position(spark, d):
    kept = _put_in_batches(spark, d, "telemetria", "escritas_posicao", "id_entregador, ts, latitude, longitude")
    return kept.selectExpr("id_entregador", "ts", _r("latitude", 9), _r("longitude", 9))


def _pages(view: str, key: str) -> None:
    """Whole rows: a page in the middle, the one that follows its last key, and one beyond the end."""

    def run(spark, d):
        folder, rows = work_path(spark, "pages"), table(spark, d, view)
        paging.write_pages(rows, key, folder, folder_rows=64)
        middle = rows.count() // 2
        page = cut_lineage(paging.page_at(spark, folder, key, middle, 100, folder_rows=64))
        last = page.agg(F.max(key)).first()[0]
        following = paging.page_after(spark, folder, key, last, 50, folder_rows=64)
        beyond = paging.page_after(spark, folder, key, 10**12, 50, folder_rows=64)
        columns = [_r(c, 9) if c in ("latitude", "longitude") else c for c in rows.columns]
        return page.unionByName(following).unionByName(beyond).selectExpr(*columns)

    REGISTRY[f"seek_{view}_pages"] = run


for _view in ("clientes", "restaurantes", "entregadores", "pedidos"):
    _pages(_view, schemas.KEYS[_view])


@query
def lookup_orders(spark, d):
    keys = table(spark, d, "novos_pedidos").selectExpr("seq * 2 + 1 AS id_pedido")
    return tables.lookup(keys, table(spark, d, "pedidos"), "id_pedido").select(
        "id_pedido", "id_cliente", "status", "found"
    )


# ---- scalar functions


@query
def haversine_distance(spark, d):
    places = reads.order_positions(*[table(spark, d, v) for v in ("pedidos", "restaurantes", "clientes")])
    return places.selectExpr(
        "id_pedido", f"round({haversine_km('rest_lat', 'rest_lon', 'cli_lat', 'cli_lon')}, 6) AS dist_km"
    )


@query
def iso_timestamps(spark, d):
    events = table(spark, d, "telemetria").select("id_entregador", "ts")
    texts = events.select("id_entregador", scalars.to_iso(F.col("ts")).alias("texto"))
    return texts.select("id_entregador", "texto", scalars.from_iso(F.col("texto")).alias("ts"))


@query
def decimal_routes(spark, d):
    """Each street as a one-hop route, stored as decimals and read back."""
    nodes, edges = table(spark, d, "grafo_nos"), table(spark, d, "grafo_arestas")
    ends = edges.join(nodes.selectExpr("node_id AS from_node", "lat AS a", "lon AS b"), "from_node").join(
        nodes.selectExpr("node_id AS to_node", "lat AS c", "lon AS e"), "to_node"
    )
    one = ends.selectExpr(
        "edge_seq",
        "array(struct(struct(a AS lat, b AS lon) AS `from`, struct(c AS lat, e AS lon) AS `to`, weight)) AS rota",
    )
    stored = one.select("edge_seq", scalars.route_as(F.col("rota"), "decimal(20,10)").alias("rota"))
    back = stored.select("edge_seq", scalars.route_as(F.col("rota"), "double").alias("rota"))
    return back.selectExpr("edge_seq", "inline(rota)").selectExpr(
        "edge_seq",
        "round(`from`.lat, 6) AS from_lat",
        "round(`from`.lon, 6) AS from_lon",
        "round(`to`.lat, 6) AS to_lat",
        "round(`to`.lon, 6) AS to_lon",
        "weight",
    )


@query
def coordinates_as_text(spark, d):
    stored = table(spark, d, "telemetria").select(
        "id_entregador", "ts", scalars.coordinate_text(F.col("latitude")).alias("t_lat"),
        scalars.coordinate_text(F.col("longitude")).alias("t_lon"),
    )
    return stored.select(
        "id_entregador",
        "ts",
        scalars.parse_coordinate(F.col("t_lat")).alias("latitude"),
        scalars.parse_coordinate(F.col("t_lon")).alias("longitude"),
    )


@query
def order_items_json(spark, d):
    requests = table(spark, d, "novos_pedidos")
    text = requests.select("seq", scalars.items_to_json(F.expr("array(struct(item, qtd))")).alias("lista_itens"))
    parsed = text.select("*", scalars.items_from_json(F.col("lista_itens")).alias("i"))
    return parsed.selectExpr("seq", "lista_itens", "CAST(i[0]['item'] AS BIGINT) AS item", "CAST(i[0]['qtd'] AS BIGINT) AS qtd")


@query
def order_items_variant(spark, d):
    """Items with numbers, an object and a list inside, stored as text, parsed and written again."""
    made = (
        """concat('[{"extras":["sal",', CAST(qtd AS STRING), ',{"nota":null}],"item":', CAST(item AS STRING), ',"preco":', CAST(item AS STRING), '.5,"qtd":', """
        """CAST(qtd AS STRING), '}', if(qtd = 2, ',{"item":{"nome":"x","tamanho":2}}', ''), ']')"""
    )
    stored = table(spark, d, "novos_pedidos").selectExpr("seq", f"{made} AS texto")
    items = stored.select("seq", "texto", scalars.items_variant(F.col("texto")).alias("i"))
    return items.select(
        "seq", "texto", scalars.variant_text(F.col("i")).alias("volta"),
        F.expr("variant_get(i, '$[0].item', 'bigint') AS item"), F.expr("variant_get(i, '$[0].preco', 'double') AS preco"),
        F.expr("variant_get(i, '$[0].extras[1]', 'bigint') AS extra"), F.expr("try_variant_get(i, '$[1].item.tamanho', 'bigint') AS tamanho"),
    )


@query
def id_text(spark, d):
    """Courier ids as the event log keeps them: text, empty, ``None`` or missing."""
    kept = table(spark, d, "eventos_pedido").selectExpr(
        "id_pedido",
        "status",
        "CASE WHEN id_entregador IS NOT NULL THEN CAST(id_entregador AS STRING) "
        "WHEN status = 'CONFIRMED' THEN 'None' WHEN status = 'PREPARING' THEN '' END AS texto",
    )
    return kept.select("id_pedido", "status", "texto", scalars.parse_id(F.col("texto")).alias("id_entregador"))


@query
def event_short_ids(spark, d):
    events = table(spark, d, "eventos_pedido")
    return events.select(
        "id_pedido", "status", scalars.derived_event_id(F.col("id_pedido"), F.col("status")).alias("event_id")
    )


@query
def status_domain_rejects(spark, d):
    return table(spark, d, "atualizacoes").where(~in_domain(F.col("novo_status"))).select("seq", "id_pedido", "novo_status")


# ---- filters, sorted reads


@query
def waiting_orders(spark, d):
    return reads.waiting_orders(table(spark, d, "pedidos")).select("id_pedido", "id_restaurante", "status")


@query
def available_couriers(spark, d):
    return reads.available_couriers(table(spark, d, "entregadores")).selectExpr(
        "id_entregador", _r("latitude", 9), _r("longitude", 9)
    )


@query
def order_history(spark, d):
    return reads.order_history(table(spark, d, "eventos_pedido"))


@query
def order_history_lookup(spark, d):
    """Asked orders, half of which are unknown, with their events in an array, and with none."""
    asked = table(spark, d, "novos_pedidos").selectExpr("seq * 2 + 1 AS id_pedido")
    events = table(spark, d, "eventos_pedido").select(
        "*", scalars.derived_event_id(F.col("id_pedido"), F.col("status")).alias("event_id")
    )
    return reads.order_histories(asked, events).selectExpr("id_pedido", "found", "posexplode_outer(historico) AS (ordem, e)").selectExpr(
        "id_pedido", "found", "ordem", "e.ts AS ts", "e.status AS status", "e.event_id AS event_id", "e.id_entregador AS id_entregador"
    )


@query
def customer_orders(spark, d):
    asked = table(spark, d, "novos_pedidos").select("id_cliente")
    return reads.customer_orders(asked, table(spark, d, "clientes"), table(spark, d, "pedidos"))


@query
def current_allocation(spark, d):
    return reads.current_allocation(table(spark, d, "alocacoes"))


@query
def open_orders_by_status(spark, d):
    return reads.open_orders_by_status(table(spark, d, "pedidos"))


# ---- joins


@query
def order_positions(spark, d):
    places = reads.order_positions(*[table(spark, d, v) for v in ("pedidos", "restaurantes", "clientes")])
    return places.selectExpr(
        "id_pedido", _r("rest_lat", 9), _r("rest_lon", 9), _r("cli_lat", 9), _r("cli_lon", 9)
    )


@query
def rejected_new_orders(spark, d):
    checked = reads.check_references(*[table(spark, d, v) for v in ("novos_pedidos", "clientes", "restaurantes")])
    return checked.where("motivo IS NOT NULL").select("seq", "id_cliente", "id_restaurante", "motivo")


def _tracked(df: DataFrame) -> DataFrame:
    return df.selectExpr(
        "id_pedido", "status", "id_entregador", _r("latitude", 9), _r("longitude", 9), "ultima_atualizacao"
    )


@query
def track_orders(spark, d):
    return _tracked(tracking.track_orders(table(spark, d, "eventos_pedido"), table(spark, d, "telemetria")))


@query
def track_orders_as_of(spark, d):
    events, telemetry = table(spark, d, "eventos_pedido"), table(spark, d, "telemetria")
    return _tracked(tracking.track_orders(events, telemetry, as_of=AS_OF))


@query
def nearest_node_restaurants(spark, d):
    return nearest.nearest_nodes(table(spark, d, "restaurantes"), _nodes(spark, d), "id_restaurante")


@query
def nearest_node_customers(spark, d):
    return nearest.nearest_nodes(table(spark, d, "clientes"), _nodes(spark, d), "id_cliente")


@query
def nearest_couriers_top3(spark, d):
    free = reads.available_couriers(table(spark, d, "entregadores"))
    near = nearest.nearest_couriers(table(spark, d, "restaurantes"), free)
    waiting = reads.waiting_orders(table(spark, d, "pedidos")).select("id_pedido", "id_restaurante")
    return waiting.join(near, "id_restaurante").selectExpr("id_pedido", "id_entregador", _r("dist_km"), "rank")


@query
def idle_customers(spark, d):
    return reads.idle_customers(table(spark, d, "clientes"), table(spark, d, "pedidos"))


@query
def newly_allocated_couriers(spark, d):
    current = reads.current_allocation(table(spark, d, "alocacoes"))
    return reads.newly_allocated(current, reads.available_couriers(table(spark, d, "entregadores")))


# ---- aggregates


@query
def latest_events(spark, d):
    return tracking.latest_events(table(spark, d, "eventos_pedido"))


@query
def latest_positions(spark, d):
    return tracking.latest_positions(table(spark, d, "telemetria")).selectExpr(
        "id_entregador", "ts", _r("latitude", 9), _r("longitude", 9)
    )


@query
def latency_report(spark, d):
    return report.latency_report(table(spark, d, "requisicoes")).withColumn("mean", F.round("mean", 6))


@query
def latency_report_narrowed(spark, d):
    """The same report with brackets narrowed until 32 values are left: no group is small enough to be sorted."""
    narrowed = report.latency_report(table(spark, d, "requisicoes"), sort_limit=32)
    return narrowed.withColumn("mean", F.round("mean", 6))


@query
def latency_report_display(spark, d):
    return report.display(report.latency_report(table(spark, d, "requisicoes")))


@query
def total_requests(spark, d):
    return report.total_requests(table(spark, d, "requisicoes"))


@query
def best_courier_by_road(spark, d):
    """Every waiting order on its own: the best of the three nearest available couriers."""
    index, graph_ready = _nodes(spark, d), _roads(spark, d)
    rest = _placed(table(spark, d, "restaurantes"), index, "id_restaurante")
    free = _placed(reads.available_couriers(table(spark, d, "entregadores")), index, "id_entregador")
    lists = dp.courier_lists(rest, free, graph_ready, dp.CANDIDATES)
    # one answer per restaurant, then joined to its orders
    best = dp.best_by_road(lists.withColumnRenamed("id_restaurante", "id_pedido")).withColumnRenamed(
        "id_pedido", "id_restaurante"
    )
    waiting = reads.waiting_orders(table(spark, d, "pedidos")).select("id_pedido", "id_restaurante")
    return waiting.join(best, "id_restaurante", "left").select("id_pedido", "id_entregador", "road_dist")


def _placed(rows: DataFrame, index: nearest.NearestIndex, key: str) -> DataFrame:
    """Rows with a position, and their crossing."""
    rows = rows.select(key, "latitude", "longitude")
    return cut_lineage(rows.join(nearest.nearest_nodes(rows, index, key), key))


# ---- graph


def _crossing(spark, d, index: nearest.NearestIndex, view: str, name: str) -> DataFrame:
    """(key, name): the crossing of every row of a table that has a position."""
    key = schemas.KEYS[view]
    return nearest.nearest_nodes(table(spark, d, view), index, key).withColumnRenamed("node_id", name)


def _delivery_pairs(spark, d) -> DataFrame:
    """(source, target): restaurant and customer crossing of every waiting order."""
    waiting = reads.waiting_orders(table(spark, d, "pedidos")).select("id_restaurante", "id_cliente")
    # one descent places both; even keys are restaurants
    rest = table(spark, d, "restaurantes").selectExpr("id_restaurante * 2 AS k", "latitude", "longitude")
    cust = table(spark, d, "clientes").selectExpr("id_cliente * 2 + 1 AS k", "latitude", "longitude")
    at = cut_lineage(nearest.nearest_nodes(rest.unionByName(cust), _nodes(spark, d), "k"))
    pairs = waiting.join(at.selectExpr("k AS r", "node_id AS source"), F.expr("id_restaurante * 2 = r")).join(
        at.selectExpr("k AS c", "node_id AS target"), F.expr("id_cliente * 2 + 1 = c")
    )
    return cut_lineage(pairs.select("source", "target").distinct())


def _paths(ready: graph.Roads, pairs: DataFrame) -> DataFrame:
    return graph.paths(ready, pairs)


def _hops(spark, d, pairs: DataFrame) -> DataFrame:
    ready = _roads(spark, d)
    return cut_lineage(routes.route_hops(_paths(ready, pairs), table(spark, d, "grafo_nos"), ready.edges))


@query
def shortest_distances(spark, d):
    """Road distance of every delivery leg that is asked for."""
    found = graph.distances(_roads(spark, d), pairs=_delivery_pairs(spark, d))
    return found.select("source", "node", "d")


@query
def unreachable_pairs(spark, d):
    pairs = _delivery_pairs(spark, d)
    return graph.unreachable(pairs, graph.distances(_roads(spark, d), pairs=pairs))


@query
def paths(spark, d):
    return _paths(_roads(spark, d), _delivery_pairs(spark, d))


@query
def road_paths_shuffled(spark, d):
    """The same paths over a graph cut into regions of 16 crossings, none of it broadcast."""
    return _paths(_roads(spark, d, share=False, region_nodes=16), _delivery_pairs(spark, d))


@query
def road_distances_regions(spark, d):
    """Distances of the same legs over regions of 64 crossings."""
    found = graph.distances(_roads(spark, d, share=False, region_nodes=64), pairs=_delivery_pairs(spark, d))
    return found.select("source", "node", "d")


_HOP = ["hop", "from_node", "to_node", _r("from_lat"), _r("from_lon"), _r("to_lat"), _r("to_lon"), "weight"]


@query
def delivery_routes(spark, d):
    return _hops(spark, d, _delivery_pairs(spark, d)).selectExpr("source", "target", *_HOP)


# ---- state machine and dispatch


def _judged(spark, d) -> DataFrame:
    return order_ops.judge_updates(*[table(spark, d, v) for v in ("pedidos", "entregadores", "atualizacoes")])


_OUTCOME = ["seq", "id_pedido", "novo_status", "id_entregador", "resultado", "courier_evento"]


@query
def apply_status_updates(spark, d):
    return _judged(spark, d).select(*_OUTCOME)


@query
def accepted_status_events(spark, d):
    return order_ops.accepted_events(_judged(spark, d))


@query
def orders_after_updates(spark, d):
    return order_ops.next_orders(table(spark, d, "pedidos"), cut_lineage(_judged(spark, d))).select(
        "id_pedido", "status", "id_entregador"
    )


def _dispatch(spark, d) -> DataFrame:
    views = ("pedidos", "restaurantes", "clientes", "entregadores", "grafo_nos", "grafo_arestas")
    return dp.dispatch(*[table(spark, d, v) for v in views])


@query
def dispatch(spark, d):
    return _dispatch(spark, d).select("id_pedido", "id_entregador", "road_dist", "motivo")


@query
def dispatch_zoned(spark, d):
    """The same dispatch cut into zones of 512 orders and slices of 64, so that many zones settle together."""
    views = ("pedidos", "restaurantes", "clientes", "entregadores", "grafo_nos", "grafo_arestas")
    given = dp.dispatch(*[table(spark, d, v) for v in views], zone_orders=512, slice_orders=64)
    return given.select("id_pedido", "id_entregador", "road_dist", "motivo")


@query
def dispatch_routes(spark, d):
    """Both legs of every assigned order; an unreachable customer has an empty second leg."""
    index = _nodes(spark, d)
    given = cut_lineage(_dispatch(spark, d).where("id_entregador IS NOT NULL"))
    courier = _crossing(spark, d, index, "entregadores", "origem")
    rest = _crossing(spark, d, index, "restaurantes", "restaurante")
    cust = _crossing(spark, d, index, "clientes", "cliente")
    legs = given.join(courier, "id_entregador").join(rest, "id_restaurante").join(cust, "id_cliente").selectExpr(
        "id_pedido",
        "id_entregador",
        "inline(array(struct(1 AS perna, origem AS source, restaurante AS target), "
        "struct(2 AS perna, restaurante AS source, cliente AS target)))",
    )
    legs = cut_lineage(legs)
    hops = _hops(spark, d, legs.select("source", "target").distinct())
    return legs.join(hops, ["source", "target"]).selectExpr("id_pedido", "id_entregador", "perna", *_HOP)


def _allocations(spark, d) -> DataFrame:
    """What dispatch writes to the allocation log: both routes as decimals, and whether the customer has none."""
    views = ("pedidos", "restaurantes", "clientes", "entregadores", "grafo_nos", "grafo_arestas")
    orders, restaurants, customers, couriers, nodes, edges = [table(spark, d, v) for v in views]
    place = dp.city(restaurants, nodes, edges)
    given = cut_lineage(dp.dispatch(orders, restaurants, customers, couriers, place=place).where("id_entregador IS NOT NULL"))
    log = dp.allocation_rows(given, ALLOCATED_AT, dp.routes_of(given, couriers, customers, nodes, place))
    legs = {leg: scalars.route_as(F.col(leg), "decimal(20,10)") for leg in ("rota_restaurante", "rota_cliente")}
    return log.withColumns(legs)


@query
def dispatch_allocations(spark, d):
    return _allocations(spark, d).selectExpr(
        "id_pedido", "id_entregador", "status", "CAST(size(rota_restaurante) AS INT) AS n_restaurante",
        "CAST(size(rota_cliente) AS INT) AS n_cliente", "cliente_sem_rota",
    )


@query
def current_allocation_routes(spark, d):
    """The allocations written, stored and read back as what each courier is doing now, hop by hop."""
    folder = work_path(spark, "allocations")
    log = table(spark, d, "alocacoes").unionByName(_allocations(spark, d), allowMissingColumns=True)
    log.write.parquet(folder)
    now = reads.current_allocation(spark.read.parquet(folder)).where("rota_restaurante IS NOT NULL")
    both = now.select(
        "id_pedido", "id_entregador",
        scalars.route_as(F.col("rota_restaurante"), "double").alias("a"), scalars.route_as(F.col("rota_cliente"), "double").alias("b"),
    )
    legs = both.selectExpr("id_pedido", "id_entregador", "inline(array(struct(1 AS perna, a AS rota), struct(2 AS perna, b AS rota)))")
    return legs.selectExpr("id_pedido", "id_entregador", "perna", "posexplode(rota) AS (hop, h)").selectExpr(
        "id_pedido", "id_entregador", "perna", "hop", "round(h.`from`.lat, 6) AS from_lat", "round(h.`from`.lon, 6) AS from_lon",
        "round(h.`to`.lat, 6) AS to_lat", "round(h.`to`.lon, 6) AS to_lon", "h.weight AS weight",
    )


def _release(spark, d):
    asked = table(spark, d, "alocacoes").where("status = 'INATIVA'").select("id_entregador", "id_pedido", "ts")
    return order_ops.release(asked, *[table(spark, d, v) for v in ("entregadores", "pedidos", "clientes", "alocacoes")])


@query
def release_couriers(spark, d):
    return _release(spark, d)[1].selectExpr("id_entregador", "status", _r("latitude", 9), _r("longitude", 9))


@query
def release_allocations(spark, d):
    return _release(spark, d)[0]


def _created(spark, d):
    requests = table(spark, d, "novos_pedidos").selectExpr(
        "seq", "ts", "id_cliente", "id_restaurante", "to_json(array(struct(item, qtd))) AS lista_itens"
    )
    existing = table(spark, d, "pedidos").selectExpr("*", "CAST(NULL AS STRING) AS lista_itens", "criado_em AS ts")
    return order_ops.create_orders(requests, table(spark, d, "clientes"), table(spark, d, "restaurantes"), existing)


@query
def new_orders(spark, d):
    return _created(spark, d)[0]


@query
def new_order_events(spark, d):
    return _created(spark, d)[1]


# ---- streaming forms


def _commands(rows: DataFrame, kind: str, **columns: str) -> DataFrame:
    """Rows as commands of one kind; columns that are not named are null."""
    given = {"kind": f"'{kind}'", **{c: c for c in rows.columns}, **columns}
    fields = [c.split(" ") for c in fleet.COMMAND.split(", ")]
    return rows.selectExpr(*[f"CAST({given.get(name, 'NULL')} AS {kept}) AS {name}" for name, kept in fields])


class _Run:
    """A fleet stream over one folder: every ``feed`` lands files and runs a trigger over them."""

    def __init__(self, spark, d, assign: bool = True):
        self.spark, self.folder, self.assign = spark, work_path(spark, "fleet"), assign
        self.town = fleet.town(*[table(spark, d, v) for v in ("restaurantes", "clientes", "grafo_nos", "grafo_arestas")])
        self.state = fleet.start(
            spark, f"{self.folder}/state", *[table(spark, d, v) for v in ("pedidos", "entregadores", "eventos_pedido", "alocacoes")]
        )

    def feed(self, commands: DataFrame) -> None:
        commands.write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(fleet.COMMAND).parquet(f"{self.folder}/in")
        fleet.run_fleet(stream, self.state, f"{self.folder}/checkpoint", self.town, self.assign).awaitTermination()


def _updated(spark, d) -> _Run:
    """All status updates, the first half of them in one trigger and the others in the next."""
    run = _Run(spark, d, assign=False)
    # worked out once; spread by number, as one order has a third of them
    updates = cut_lineage(_commands(table(spark, d, "atualizacoes"), "STATUS").repartition("seq"))
    half = updates.agg(F.max("seq")).first()[0] // 2
    run.feed(updates.where(F.col("seq") <= half))
    run.feed(updates.where(F.col("seq") > half))
    return run


def _live_positions(spark, d):
    """Telemetry in three triggers, the newest third first."""
    folder, telemetry = work_path(spark, "telemetry"), table(spark, d, "telemetria")
    state = live_positions.position_state(spark, f"{folder}/state")
    first, last = telemetry.agg(F.min(F.unix_date(F.to_date("ts"))), F.max(F.unix_date(F.to_date("ts")))).first()
    third = F.floor((F.unix_date(F.to_date("ts")) - first) * 3 / (last - first + 1))
    for part in (2, 0, 1):
        telemetry.where(third == part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(telemetry.schema).parquet(f"{folder}/in")
        live_positions.run_positions(stream, state, f"{folder}/checkpoint").awaitTermination()
    return state


@query
def stream_status(spark, d):
    return _updated(spark, d).state.read("resultados").select(*_OUTCOME)


@query
def stream_positions(spark, d):
    return _live_positions(spark, d).read("posicoes").selectExpr("id_entregador", "ts", _r("latitude", 9), _r("longitude", 9))


@query
def stream_tracking(spark, d):
    return _tracked(live_tracking(_updated(spark, d).state, _live_positions(spark, d)))


def _tick(spark, ts: str) -> DataFrame:
    return _commands(spark.sql(f"SELECT 0L AS seq, timestamp_ntz'{ts}' AS ts"), "TICK")


@query
def stream_dispatch(spark, d):
    """Nothing arrives but a tick: the orders that wait are dispatched."""
    run = _Run(spark, d)
    run.feed(_tick(spark, ALLOCATED_AT))
    return run.state.read("despachos").select("id_pedido", "id_entregador", "road_dist", "motivo")


@query
def stream_fleet(spark, d):
    """Two triggers. All requests create orders, and the orders that wait are dispatched. Then every order that was given a courier is
    brought and its courier released, a third of the new orders is prepared, and who was released takes the next orders."""
    run = _Run(spark, d)
    requests = table(spark, d, "novos_pedidos").selectExpr("*", "to_json(array(struct(item, qtd))) AS lista_itens")
    run.feed(_commands(requests, "PEDIDO"))
    orders, before = run.state.read("pedidos"), table(spark, d, "pedidos").select(F.col("id_pedido").alias("old"))
    given = run.state.read("despachos").where("id_entregador IS NOT NULL").select("id_pedido", F.col("id_entregador").alias("courier"))
    given = cut_lineage(orders.join(given, "id_pedido"))
    steps = given.withColumn("passo", F.explode(F.sequence(step_of(F.col("status")) + 1, F.lit(len(LIFECYCLE) - 1))))
    steps = steps.select(
        "id_pedido", (F.col("id_pedido") * 10 + F.col("passo")).alias("seq"), status_at(F.col("passo")).alias("novo_status"),
        F.expr(f"timestamp_ntz'{ALLOCATED_AT}' + make_dt_interval(0, 0, passo)").alias("ts"),
    )
    new = orders.join(before, F.col("id_pedido") == F.col("old"), "left_anti").where("id_pedido % 3 = 0")
    prepared = new.selectExpr("id_pedido", "id_pedido * 10 AS seq", "'PREPARING' AS novo_status", f"timestamp_ntz'{ALLOCATED_AT}' AS ts")
    freed = given.selectExpr("id_pedido", "courier AS id_entregador", "id_pedido AS seq", f"timestamp_ntz'{ALLOCATED_AT}' + INTERVAL '1' DAY AS ts")
    parts = [_commands(steps, "STATUS"), _commands(prepared, "STATUS"), _commands(freed, "LIBERACAO")]
    run.feed(reduce(DataFrame.unionByName, parts))
    state = run.state
    tables = [
        state.read("pedidos").selectExpr("'pedido' AS tabela", "id_pedido AS chave", "status", "id_entregador AS outro"),
        state.read("entregadores").selectExpr("'entregador'", "id_entregador", "status", "CAST(NULL AS BIGINT)"),
        state.read("alocacoes").selectExpr("'alocacao'", "id_entregador", "status", "id_pedido"),
    ]
    return reduce(DataFrame.union, tables)
