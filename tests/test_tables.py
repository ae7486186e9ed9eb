from pyspark.sql import functions as F

from frota.functions import scalars, status
from frota.operators import reads, tracking
from frota.operators.numbering import dense_ids
from frota.session import work_path
from frota.sources import paging, road_graph, schemas, tables


def test_dense_ids_cover_every_row_once(spark):
    df = spark.range(1000).selectExpr("999 - id AS v")
    got = dense_ids(df, ["v"], "n", start=5).collect()
    assert all(r.n == r.v + 5 for r in got) and len(got) == 1000


def test_graph_files_keep_order_and_repeated_nodes(spark, tmp_path):
    (tmp_path / "nodes.csv").write_text("node_id,lat,lon\n5,1.0,1.0\n2,2.0,2.0\n5,9.0,8.0\n")
    (tmp_path / "edges.csv").write_text("from_node,to_node,weight\n5,2,7.5\n5,2,1.0\n2,5,3.0\n2,77,1.0\n5,5,-1.0\n")
    nodes = road_graph.read_nodes(spark, str(tmp_path / "nodes.csv"))
    edges = road_graph.read_edges(spark, str(tmp_path / "edges.csv"))
    assert [tuple(r) for r in nodes.orderBy("node_pos").select("node_id", "lat", "lon").collect()] == [(5, 9.0, 8.0), (2, 2.0, 2.0)]
    assert [r.weight for r in edges.orderBy("edge_seq").collect()] == [7.5, 1.0, 3.0, 1.0, -1.0]
    good, bad = road_graph.checked_edges(nodes, edges)
    assert good.count() == 3
    assert sorted((r.to_node, r.motivo) for r in bad.collect()) == [(5, "PESO"), (77, "NO_DESCONHECIDO")]
    folder = work_path(spark, "test-graph")
    road_graph.write_graph(nodes, good, f"{folder}/n", f"{folder}/e")
    assert sorted(map(tuple, road_graph.read_edges(spark, f"{folder}/e").collect())) == sorted(map(tuple, good.collect()))
    sized = road_graph.edges_with_length(spark.createDataFrame([(1, 1, 2, None)], "edge_seq bigint, from_node bigint, to_node bigint, length double"))
    assert sized.first().weight == 1.0


def test_put_lookup_page_insert(spark):
    log = spark.createDataFrame([(1, 1, "a", 1), (1, 1, "b", 2), (2, 1, "c", 3)], "k bigint, ts bigint, v string, w bigint")
    assert sorted(r.v for r in tables.put_by_key(log, "k", "ts", "w").collect()) == ["b", "c"]
    found = tables.lookup(spark.createDataFrame([(1,), (9,)], "k bigint"), log.where("w = 1"), "k")
    assert {r.k: r.found for r in found.collect()} == {1: True, 9: False}
    couriers = spark.createDataFrame([(4, "x", "BUSY")], "id_entregador bigint, nome string, status string")
    new = tables.insert_rows(couriers, spark.createDataFrame([("b",), ("a",)], "nome string"), "entregadores", ["nome"])
    assert sorted(map(tuple, new.collect())) == [(5, "a", "AVAILABLE"), (6, "b", "AVAILABLE")]
    assert [r.id for r in tables.page(spark.range(50), "id", 20, 3).collect()] == [20, 21, 22]


def test_pages_by_place_and_by_key_read_few_folders(spark):
    folder = work_path(spark, "test-pages")
    table = spark.range(1000).selectExpr("id * 3 AS id", "concat('v', id) AS v", "id AS _rn")
    paging.write_pages(table, "id", folder, folder_rows=50)
    assert [r.id for r in paging.page_at(spark, folder, "id", 120, 3, folder_rows=50).collect()] == [360, 363, 366]
    page = paging.page_after(spark, folder, "id", 447, 4, folder_rows=50)
    assert [(r.id, r.v) for r in page.collect()] == [(450, "v150"), (453, "v151"), (456, "v152"), (459, "v153")]
    assert sorted(page.columns) == ["_rn", "id", "v"] and len({f for f in page.inputFiles()}) <= 20
    assert [r.id for r in paging.page_after(spark, folder, "id", None, 2, folder_rows=50).collect()] == [0, 3]
    assert [r.id for r in paging.page_after(spark, folder, "id", 2990, 9, folder_rows=50).collect()] == [2991, 2994, 2997]
    assert paging.page_after(spark, folder, "id", 2997, 9, folder_rows=50).count() == 0
    assert "PartitionFilters: [isnotnull(_folder" in page._jdf.queryExecution().toString()


def test_small_pages_do_not_make_many_folders(spark):
    folder = work_path(spark, "test-pages")
    paging.write_pages(spark.range(3000).selectExpr("id * 2 AS id"), "id", folder, folder_rows=10)
    assert len(spark.read.parquet(f"{folder}/rows").inputFiles()) <= 4
    assert spark.read.parquet(f"{folder}/index").count() == 300
    assert [r.id for r in paging.page_at(spark, folder, "id", 1995, 12, folder_rows=10).collect()] == list(range(3990, 4014, 2))
    assert [r.id for r in paging.page_after(spark, folder, "id", 3999, 11, folder_rows=10).collect()] == list(range(4000, 4022, 2))


def test_histories_tell_unknown_orders(spark):
    events = spark.sql("""SELECT * FROM VALUES (1L, timestamp_ntz'2024-01-02 00:00:00', 'PREPARING', 'b', CAST(NULL AS BIGINT)),
        (1L, timestamp_ntz'2024-01-01 00:00:00', 'CONFIRMED', 'a', NULL) AS t(id_pedido, ts, status, event_id, id_entregador)""")
    asked = spark.createDataFrame([(1,), (1,), (404,)], "id_pedido bigint")
    got = {r.id_pedido: (r.found, [e.event_id for e in r.historico]) for r in reads.order_histories(asked, events).collect()}
    assert got == {1: (True, ["a", "b"]), 404: (False, [])}


def test_items_of_any_shape(spark):
    texts = ['[{"a":1.5,"b":[1,{"c":null}]},"x",7]', "[]", "no json", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.variant_text(scalars.items_variant(F.col("t"))))
    assert [r[0] for r in rows.collect()] == [texts[0], "[]", None, None]


def test_constraint_violations(spark):
    frames = {
        "clientes": spark.createDataFrame([(1,), (1,)], "id_cliente bigint"),
        "restaurantes": spark.createDataFrame([(1,)], "id_restaurante bigint"),
        "entregadores": spark.createDataFrame([(1,)], "id_entregador bigint"),
        "pedidos": spark.createDataFrame([(1, 1, 2, None)], "id_pedido bigint, id_cliente bigint, id_restaurante bigint, id_entregador bigint"),
    }
    got = {(r.tabela, r.regra, r.valor, r.n) for r in schemas.constraint_violations(frames).collect()}
    assert got == {("clientes", "chave", 1, 2), ("pedidos", "referencia", 2, 1)}


def test_scalars(spark):
    df = spark.createDataFrame([("None",), ("",), (None,), ("0",), ("17",)], "t string")
    assert [r[0] for r in df.select(scalars.parse_id(F.col("t"))).collect()] == [None, None, None, 0, 17]
    iso = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2024-01-01 10:00:00'), (timestamp_ntz'2024-01-01 10:00:00.5') AS t(ts)")
    texts = [r[0] for r in iso.select(scalars.to_iso(F.col("ts"))).collect()]
    assert texts == ["2024-01-01T10:00:00", "2024-01-01T10:00:00.500000"] and texts == sorted(texts)
    assert iso.where(scalars.from_iso(scalars.to_iso(F.col("ts"))) == F.col("ts")).count() == 2
    steps = spark.createDataFrame([(s,) for s in ["CONFIRMED", "DELIVERED", "??"]], "s string")
    assert [r[0] for r in steps.select(status.next_status(F.col("s"))).collect()] == ["PREPARING", None, None]


def test_reads_and_tracking(spark):
    alloc = spark.sql("""SELECT * FROM VALUES (1L, timestamp_ntz'2024-01-01 00:00:00', 'ATIVA', 5L), (1L, timestamp_ntz'2024-01-02 00:00:00', 'INATIVA', 5L),
        (2L, timestamp_ntz'2024-01-01 00:00:00', 'ATIVA', 6L) AS t(id_entregador, ts, status, id_pedido)""")
    current = reads.current_allocation(alloc)
    assert {r.id_entregador: r.id_pedido for r in current.collect()} == {1: None, 2: 6}
    idle = spark.createDataFrame([(1,), (2,)], "id_entregador bigint")
    assert [r.id_entregador for r in reads.newly_allocated(current, idle).collect()] == [2]
    events = spark.sql("""SELECT * FROM VALUES (1L, timestamp_ntz'2024-01-01 00:00:00', 'CONFIRMED', CAST(NULL AS BIGINT)),
        (1L, timestamp_ntz'2024-01-03 00:00:00', 'PICKED_UP', 4L), (2L, timestamp_ntz'2024-01-01 00:00:00', 'CONFIRMED', NULL) AS t(id_pedido, ts, status, id_entregador)""")
    telemetry = spark.sql("SELECT * FROM VALUES (4L, timestamp_ntz'2024-01-02 00:00:00', 1D, 2D), (4L, timestamp_ntz'2024-01-01 00:00:00', 3D, 4D) AS t(id_entregador, ts, latitude, longitude)")
    now = {r.id_pedido: (r.status, r.latitude) for r in tracking.track_orders(events, telemetry).collect()}
    assert now == {1: ("PICKED_UP", 1.0), 2: ("CONFIRMED", None)}
    before = {r.id_pedido: r.status for r in tracking.track_orders(events, telemetry, "2024-01-02 12:00:00").collect()}
    assert before[1] == "CONFIRMED"
    missing = reads.order_history(events, spark.createDataFrame([(404,)], "id_pedido bigint"))
    assert missing.count() == 0


def test_items_keep_every_key(spark):
    text = spark.createDataFrame([('[{"nome":"pizza","qtd":2,"preco":9.5}]',), ("[]",), (None,)], "t string")
    got = [r[0] for r in text.select(scalars.items_from_json(F.col("t"))).collect()]
    assert got == [[{"nome": "pizza", "qtd": "2", "preco": "9.5"}], [], None]
