"""Incremental gallery ingest, generation switch and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.operators.graph import GalleryGraph, build_graph
from matchbook.operators.similarity import Plan
from matchbook.operators.upkeep import OVERLAYS, Touched, update_graph, written_out
from matchbook.operators.verify import fingerprint
from matchbook.session import durable, ship
from matchbook.sources.store import GalleryStore


def ingest_batch(store: GalleryStore, batch: DataFrame) -> int:
    """Append the new observations of a batch; ids already stored, or seen before in the batch, are left out."""
    once = batch.groupBy("image_id").agg(F.min_by(F.struct(*batch.columns), "ord").alias("_r")).select("_r.*")
    new = durable(once.join(store.snapshot().select("image_id"), "image_id", "left_anti"), "arrivals")
    n = new.count()
    if n:
        store.add_many(new)
    return n


def ingest_stream(items: DataFrame, store: GalleryStore, checkpoint: str):
    """Start the stream; a replayed batch adds nothing."""

    def run(batch: DataFrame, n: int) -> None:
        ship(batch.sparkSession)
        ingest_batch(store, batch)

    return items.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Generations:
    """The published gallery generation and its graph.

    The first generation is built as a whole. From then on ``register`` compares the new content
    with the published one and brings the graph up to date for the rows that came, went or
    changed; ``insert`` and ``delete`` say themselves which. Everything for the new content is
    computed first and then switched to; a failure keeps the old generation, and unchanged content
    is recognised by its fingerprint. ``touched`` tells what the last change computed.
    """

    def __init__(self, k1: int = 3, k2: int = 2, plan: Plan = Plan()):
        self.k1, self.k2, self.plan = k1, k2, plan
        self.generation: tuple | None = None
        self.gallery: DataFrame | None = None
        self.graph: GalleryGraph | None = None
        self.touched: Touched | None = None
        self.registrations = self.hits = self.builds = self._overlays = 0

    def register(self, gallery: DataFrame) -> tuple:
        generation = self._identity(gallery)
        if generation == self.generation:
            self.hits += 1
            return generation
        if self.graph is None:
            graph = build_graph(gallery, self.k1, self.k2, self.plan, check=True)
            self.builds += 1
            return self._switch(gallery, graph, generation, None)
        marked = lambda df, name: df.select(F.col("ord"), F.xxhash64("key", *sorted({c for rule in self.plan.exclude for c in rule} | set(self.plan.require)), F.to_json("emb")).alias(name))
        both = durable(marked(self.gallery, "old").join(marked(gallery, "new"), "ord", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new"))), "changes")
        added = gallery.join(both.filter("new is not null").select("ord"), "ord", "left_semi")
        return self._update(gallery, added, both.filter("old is not null").select(F.col("ord").alias("i")), generation)

    def insert(self, rows: DataFrame) -> tuple:
        """Publish the gallery with further observations (new ordinals and keys)."""
        added = durable(rows.select(*self.gallery.columns), "added")
        gallery = self.gallery.unionByName(added)
        return self._update(gallery, added, _no_rows(added), self._identity(gallery))

    def delete(self, key: str) -> tuple:
        """Drop one observation and publish the gallery without it; an unknown key changes nothing."""
        gone = durable(self.gallery.filter(F.col("key") == key).select(F.col("ord").alias("i")), "gone")
        gallery = self.gallery.filter(F.col("key") != key)
        generation = self._identity(gallery)
        if generation == self.generation:
            self.hits += 1
            return generation
        return self._update(gallery, self.gallery.limit(0), gone, generation)

    def _identity(self, gallery: DataFrame) -> tuple:
        row = fingerprint(gallery.withColumn("_v", F.to_json("emb")), ["ord", "key", "_v"]).first()
        if row["n"] < 10:
            raise ValueError("a gallery needs at least ten observations")
        if gallery.groupBy("key").count().filter("count > 1").limit(1).count():
            raise ValueError("gallery keys must be unique")
        return row["n"], row["digest"], row["total"]

    def _update(self, gallery: DataFrame, added: DataFrame, removed: DataFrame, generation: tuple) -> tuple:
        graph, touched = update_graph(self.graph, gallery, added, removed, check=True)
        overlays = self._overlays + 1
        if overlays >= OVERLAYS:
            graph, gallery, overlays = written_out(graph), durable(gallery, "gallery"), 0
        self._overlays = overlays
        return self._switch(gallery, graph, generation, touched)

    def _switch(self, gallery: DataFrame, graph: GalleryGraph, generation: tuple, touched: Touched | None) -> tuple:
        self.gallery, self.graph, self.generation, self.touched = gallery, graph, generation, touched
        self.registrations += 1
        return generation


def _no_rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("ord").alias("i")).limit(0)
