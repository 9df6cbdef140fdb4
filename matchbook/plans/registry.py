"""The catalogue of runnable queries and the SQL each one must agree with."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchbook.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its definition over the same tables."""

    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


#: Shared definitions. Each one may use those above it.
CTES: dict[str, str] = {
    "o": """
        SELECT vec_id AS ord, 'f'||(vec_id//2)||'#'||(vec_id%2) AS key, 'f'||(vec_id//2) AS frame,
               label::BIGINT AS vehicle_id, (vec_id%4+1)::INTEGER AS camera_id,
               ((vec_id*37)%900)::DOUBLE AS x, ((vec_id*53)%500)::DOUBLE AS y,
               (180+(vec_id*17)%400)::DOUBLE AS w, (140+(vec_id*29)%300)::DOUBLE AS h,
               list_transform(embedding::DOUBLE[], lambda v: v / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS emb,
               list_transform(embedding[33:64]::DOUBLE[], lambda v: v / greatest(sqrt(list_inner_product(embedding[33:64]::DOUBLE[], embedding[33:64]::DOUBLE[])), 1e-12)) AS emb2
        FROM embeddings""",
    "q": "SELECT * FROM o WHERE ord % 5 = 0",
    "g": "SELECT * FROM o WHERE ord % 5 <> 0 AND vehicle_id NOT IN (8, 9)",
    "p": """
        SELECT q.ord AS q_ord, g.ord AS g_ord, q.key AS q_key, g.key AS g_key,
               q.vehicle_id AS q_vehicle_id, g.vehicle_id AS g_vehicle_id,
               q.camera_id AS q_camera_id, g.camera_id AS g_camera_id,
               list_inner_product(q.emb, g.emb) AS sim, list_inner_product(q.emb2, g.emb2) AS sim2
        FROM q JOIN g ON q.frame <> g.frame""",
    "r": "SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY sim DESC, g_ord) AS pos FROM p",
    # Decision table of raw-cosine search: the candidate, its confidence and the truth.
    "d": """
        SELECT q.ord AS q_ord, q.key AS q_key, q.vehicle_id, r.g_ord, r.g_key, r.sim AS conf,
               r.g_vehicle_id = q.vehicle_id AS correct,
               EXISTS (SELECT 1 FROM g WHERE g.vehicle_id = q.vehicle_id AND g.frame <> q.frame) AS has_match
        FROM q JOIN r ON r.q_ord = q.ord AND r.pos = 1""",
    # Valid positives per query after junk removal.
    "nv": """
        SELECT q.ord AS q_ord, count(g.ord) AS n_valid
        FROM q LEFT JOIN g ON g.vehicle_id = q.vehicle_id AND g.camera_id <> q.camera_id
        GROUP BY q.ord""",
}


def with_ctes(names: str, body: str, **extra: str) -> str:
    """SQL text with the named shared definitions and any further local ones, in order."""
    parts = [f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in CTES if n in names.split()]
    parts += [f"{n} AS MATERIALIZED ({s.strip()})" for n, s in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
