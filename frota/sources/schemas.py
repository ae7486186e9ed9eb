"""Table schemas, keys, references and a constraint check (no inference anywhere)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

CLIENTES = "id_cliente bigint, nome string, email string, telefone string, latitude double, longitude double"
RESTAURANTES = "id_restaurante bigint, nome string, tipo_cozinha string, latitude double, longitude double"
ENTREGADORES = (
    "id_entregador bigint, nome string, tipo_veiculo string, status string, latitude double, longitude double"
)
PEDIDOS = (
    "id_pedido bigint, id_cliente bigint, id_restaurante bigint, id_entregador bigint, "
    "lista_itens string, status string, data date, horario string"
)
EVENTOS = "id_pedido bigint, ts timestamp_ntz, status string, event_id string, id_entregador bigint"
TELEMETRIA = "id_entregador bigint, ts timestamp_ntz, latitude double, longitude double"
NOS = "node_id bigint, lat double, lon double"
ARESTAS = "edge_seq bigint, from_node bigint, to_node bigint, weight double"
ARESTAS_CSV = "from_node bigint, to_node bigint, weight double"
REQUISICOES = "status string, latency double, ritmo_idx int, method string, user string, error string"

# Primary keys and foreign keys (column -> referenced table).
KEYS = {
    "clientes": "id_cliente",
    "restaurantes": "id_restaurante",
    "entregadores": "id_entregador",
    "pedidos": "id_pedido",
}
REFERENCES = {
    "pedidos": {"id_cliente": "clientes", "id_restaurante": "restaurantes", "id_entregador": "entregadores"}
}
# Column defaults of inserted rows.
DEFAULTS = {"entregadores": {"status": "AVAILABLE"}, "pedidos": {"status": "CONFIRMED"}}


def constraint_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(tabela, regra, coluna, valor, n): repeated or missing keys and dangling references."""
    found = []
    for name, df in tables.items():
        key = KEYS[name]
        found.append(
            df.groupBy(F.col(key).alias("valor"))
            .agg(F.count("*").alias("n"))
            .where("n > 1 OR valor IS NULL")
            .select(F.lit(name).alias("tabela"), F.lit("chave").alias("regra"), F.lit(key).alias("coluna"), "valor", "n")
        )
        for column, parent in REFERENCES.get(name, {}).items():
            parent_key = tables[parent].select(F.col(KEYS[parent]).alias("valor"))
            found.append(
                # one row per value before the join, so a hot reference costs one row
                df.where(F.col(column).isNotNull())
                .groupBy(F.col(column).alias("valor"))
                .agg(F.count("*").alias("n"))
                .join(parent_key, "valor", "left_anti")
                .select(
                    F.lit(name).alias("tabela"),
                    F.lit("referencia").alias("regra"),
                    F.lit(column).alias("coluna"),
                    "valor",
                    "n",
                )
            )
    return reduce(DataFrame.unionByName, found)
