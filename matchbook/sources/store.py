"""The versioned gallery store.

Rows live in immutable Parquet segments, each a range of sequence numbers; a delete writes a
vector of the sequence numbers that are gone. A version is a small manifest that names the live
segments and vectors. It is written beside the log and renamed into it when complete, so a reader
sees a whole version or none. A change therefore writes what it adds or takes away, and never the
rest of the gallery; :meth:`GalleryStore.compact` merges small segments and drops what is deleted.
Image bytes live in their own table, so searches never read them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchbook.functions.text import valid_id
from matchbook.functions.vectors import all_finite, norm
from matchbook.operators.ranks import running
from matchbook.session import durable

COLUMNS = ("sequence", "image_id", "x", "y", "w", "h", "emb", "feature_ref", "created_at")
SCHEMA = "sequence long, image_id string, x double, y double, w double, h double, emb array<float>, feature_ref string, created_at timestamp"
#: Rows that a page may sort; larger ranges are first cut into PAGE_SLICES ranges and counted.
PAGE_ROWS, PAGE_SLICES = 1 << 16, 1024
#: A segment with fewer rows is small, and one with a larger share of deleted rows is worth a rewrite.
SMALL_ROWS, DELETED_SHARE = 1 << 20, 0.3


def content_revision(image: str = "image_bytes", box=("x", "y", "w", "h")):
    """Content key of an observation: hash of the image hash and its box."""
    b = F.to_json(F.array(*[F.col(c) for c in box]))
    return F.sha2(F.concat(F.sha2(image, 256), F.lit("|"), b).cast("binary"), 256)


def item_problems(items: DataFrame, dimension: int, tolerance: float = 1e-3) -> DataFrame:
    """Add ``problem``: the first rule an item breaks, or NULL."""
    e = F.col("emb").cast("array<double>")
    bad_box = F.lit(False)
    for c in "xywh":
        v = F.col(c)
        bad_box = bad_box | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    bad_box = bad_box | (F.col("x") < 0) | (F.col("y") < 0) | (F.col("w") <= 0) | (F.col("h") <= 0)
    return items.withColumn(
        "problem",
        F.when(~valid_id(F.col("image_id")), "image_id")
        .when(bad_box, "box")
        .when((F.size("emb") != dimension) | ~all_finite(e), "vector")
        .when(F.abs(norm(e) - 1.0) > tolerance, "norm"),
    )


@dataclass(frozen=True)
class Segment:
    """Rows of one folder: a range of sequence numbers, how many were written, how many of them are deleted."""

    name: str
    first: int
    last: int
    rows: int
    deleted: int = 0

    @property
    def live(self) -> int:
        return self.rows - self.deleted


@dataclass(frozen=True)
class Manifest:
    """One version: live segments in sequence order, delete vectors with the segments they touch."""

    version: int = 0
    operation: str = ""
    written: int = 0
    last_sequence: int = 0
    segments: tuple[Segment, ...] = ()
    vectors: tuple[tuple[str, tuple[str, ...]], ...] = ()
    identity: dict[str, str] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(**{**d, "segments": tuple(Segment(**s) for s in d["segments"]), "vectors": tuple((n, tuple(t)) for n, t in d["vectors"])})


class GalleryStore:
    """Append, delete, read and page a gallery kept as a log of segments and delete vectors.

    One writer at a time: a change first claims the next version, which only one can. A writer
    that dies leaves its claim behind and the old version current; :meth:`release` clears it.
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int, identity: dict[str, str] | None = None):
        self.spark, self.path, self.dimension = spark, path.rstrip("/"), dimension
        self.identity = {k: str(v) for k, v in (identity or {}).items()}
        if self.version and self.manifest().identity != self.identity:
            raise ValueError("gallery belongs to another model, recipe or dimension")

    # -- versions ---------------------------------------------------------------------------

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _numbers(self, kind: str) -> list[int]:
        fs, path = self._fs()
        found = fs.globStatus(path(f"{self.path}/log/*.{kind}"))
        return sorted(int(s.getPath().getName().split(".")[0]) for s in (found or []))

    @property
    def version(self) -> int:
        return (self._numbers("json") or [0])[-1]

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.version if version is None else version
        if version == 0:
            return Manifest()
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/log/{version:012d}.json"))
        try:
            return Manifest.from_json(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _claim(self) -> Manifest:
        """The current manifest, with the next version reserved for this writer."""
        fs, path = self._fs()
        current = self.manifest()
        try:
            # create() without overwrite: of two writers only one gets the claim.
            fs.create(path(f"{self.path}/log/{current.version + 1:012d}.claim"), False).close()
        except Exception as error:
            raise RuntimeError(f"another writer holds version {current.version + 1}") from error
        if self.version != current.version:
            raise RuntimeError("another writer was faster")
        return current

    def release(self) -> None:
        """Give up the claim of a writer that failed; versions already published stay."""
        fs, path = self._fs()
        for n in self._numbers("claim"):
            if n > self.version:
                fs.delete(path(f"{self.path}/log/{n:012d}.claim"), False)

    def _commit(self, old: Manifest, operation: str, written: int, **changes) -> int:
        """Publish the next version; until the rename it does not exist for readers."""
        new = replace(old, version=old.version + 1, operation=operation, written=written, identity=old.identity or self.identity, **changes)
        fs, path = self._fs()
        ready = path(f"{self.path}/log/{uuid.uuid4().hex}.tmp")
        out = fs.create(ready, False)
        out.write(bytearray(new.to_json().encode()))
        out.close()
        if not fs.rename(ready, path(f"{self.path}/log/{new.version:012d}.json")):
            raise RuntimeError(f"version {new.version} could not be published")
        return new.version

    def _changed(self, change) -> int:
        """Run ``change`` on the claimed manifest; a failure gives the claim back and leaves the old version current."""
        old = self._claim()
        try:
            return change(old)
        except BaseException:
            self.release()
            raise

    def _segment(self, rows: DataFrame) -> Segment | None:
        """Write rows in sequence order as a segment; None if there are none."""
        name = uuid.uuid4().hex
        rows.select(*COLUMNS).repartitionByRange("sequence").sortWithinPartitions("sequence").write.parquet(f"{self.path}/segments/{name}")
        r = self._rows([Segment(name, 0, 0, 0)]).agg(F.min("sequence").alias("a"), F.max("sequence").alias("b"), F.count(F.lit(1)).alias("n")).first()
        return Segment(name, r.a, r.b, r.n) if r.n else None

    def _rows(self, segments) -> DataFrame:
        folders = [f"{self.path}/segments/{s.name}" for s in segments]
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def _live(self, manifest: Manifest, segments=None) -> DataFrame:
        """Rows of some segments (all by default) without those that a vector names."""
        segments = manifest.segments if segments is None else segments
        names = {s.name for s in segments if s.deleted}
        vectors = [f"{self.path}/vectors/{n}" for n, touched in manifest.vectors if names & set(touched)]
        rows = self._rows(segments)
        return rows.join(self.spark.read.schema("sequence long").parquet(*vectors), "sequence", "left_anti").select(*COLUMNS) if vectors else rows

    def snapshot(self, version: int | None = None) -> DataFrame:
        return self._live(self.manifest(version))

    def history(self) -> DataFrame:
        """version, operation, rows written by it, segments, vectors and live rows of every version."""
        rows = [(m.version, m.operation, m.written, len(m.segments), len(m.vectors), sum(s.live for s in m.segments)) for m in map(self.manifest, self._numbers("json"))]
        return self.spark.createDataFrame(rows, "version long, operation string, written long, segments long, vectors long, live long")

    # -- changes ----------------------------------------------------------------------------

    def publish(self, rows: DataFrame) -> int:
        """Replace the whole content by ``rows`` (with their sequence numbers)."""

        def change(old: Manifest) -> int:
            s = self._segment(rows)
            return self._commit(old, "replace", s.rows if s else 0, segments=(s,) if s else (), vectors=(), last_sequence=max(old.last_sequence, s.last if s else 0))

        return self._changed(change)

    def add_many(self, items: DataFrame) -> int:
        """Append a batch: all of it or, on any invalid or repeated id, none of it. Writes the batch only."""

        def change(old: Manifest) -> int:
            batch = durable(items, "batch")
            bad = item_problems(batch, self.dimension).filter(F.col("problem").isNotNull()).select("image_id", "problem")
            twice = batch.groupBy("image_id").count().filter("count > 1").select("image_id", F.lit("repeated in batch").alias("problem"))
            known = batch.join(self._live(old).select("image_id"), "image_id", "left_semi").select("image_id", F.lit("already stored").alias("problem"))
            wrong = bad.union(twice).union(known).limit(1).collect()
            if wrong:
                raise ValueError(f"{wrong[0]['problem']}: {wrong[0]['image_id']}")
            # Sequence numbers follow the batch order without a single sorting task.
            new = running(batch, "ord", "ord", settled=True).select(
                (F.col("rank") + old.last_sequence).cast("long").alias("sequence"), "image_id", *[F.col(c).cast("double").alias(c) for c in "xywh"],
                F.col("emb").cast("array<float>").alias("emb"), "feature_ref", F.current_timestamp().alias("created_at"))
            s = self._segment(new)
            return self._commit(old, "append", s.rows if s else 0, segments=(*old.segments, *([s] if s else [])), last_sequence=s.last if s else old.last_sequence)

        return self._changed(change)

    def delete_many(self, ids: DataFrame) -> int:
        """Remove every stored id of ``ids`` (image_id); returns how many there were. Writes one vector."""
        gone = 0

        def change(old: Manifest) -> int:
            nonlocal gone
            name = uuid.uuid4().hex
            self._live(old).select("image_id", "sequence").join(ids.select("image_id").distinct(), "image_id", "left_semi").select("sequence").write.parquet(f"{self.path}/vectors/{name}")
            vector = self.spark.read.schema("sequence long").parquet(f"{self.path}/vectors/{name}")
            # Segments are ranges in order, so their first numbers place every deleted row.
            at = F.greatest(*[F.when(F.col("sequence") >= s.first, i).otherwise(-1) for i, s in enumerate(old.segments)], F.lit(-1), F.lit(-1))
            per = {r.at: r["count"] for r in vector.groupBy(at.alias("at")).count().collect()} if old.segments else {}
            gone = sum(per.values())
            if not gone:
                raise _Nothing
            segments = tuple(replace(s, deleted=s.deleted + per.get(i, 0)) for i, s in enumerate(old.segments))
            touched = tuple(old.segments[i].name for i in sorted(per))
            return self._commit(old, "delete", gone, segments=tuple(s for s in segments if s.live), vectors=_useful((*old.vectors, (name, touched)), segments))

        try:
            self._changed(change)
        except _Nothing:
            return 0
        return gone

    def delete(self, image_id: str) -> bool:
        """Remove one id in a new version; says whether it was there."""
        return self.delete_many(self.spark.createDataFrame([(image_id,)], "image_id string")) == 1

    def compact(self, small_rows: int = SMALL_ROWS, deleted_share: float = DELETED_SHARE) -> int:
        """Merge neighbouring small segments and rewrite those with many deleted rows; the content stays.

        Returns the rows written. Large segments with few deletes are left as they are.
        """
        written = 0

        def change(old: Manifest) -> int:
            nonlocal written
            runs: list[list[Segment]] = []
            for s in old.segments:
                if s.live < small_rows or s.deleted > deleted_share * s.rows:
                    if runs and runs[-1] and sum(x.live for x in runs[-1]) < small_rows:
                        runs[-1].append(s)
                    else:
                        runs.append([s])
                else:
                    runs.append([])  # a segment that stays ends a run
            merged: dict[str, Segment | None] = {}
            for run in runs:
                if len(run) > 1 or run and run[0].deleted:
                    new = self._segment(self._live(old, run))
                    written += new.rows
                    merged |= {s.name: None for s in run} | {run[0].name: new}
            if not merged:
                raise _Nothing
            segments = tuple(x for s in old.segments if (x := merged.get(s.name, s)) is not None)
            return self._commit(old, "compact", written, segments=segments, vectors=_useful(old.vectors, segments))

        try:
            self._changed(change)
        except _Nothing:
            return 0
        return written

    def vacuum(self, keep: int = 2) -> int:
        """Delete segments and vectors that none of the last ``keep`` versions names; older versions go with them."""
        fs, path = self._fs()
        numbers = self._numbers("json")
        kept = [self.manifest(n) for n in numbers[-keep:]]
        names = {s.name for m in kept for s in m.segments} | {n for m in kept for n, _ in m.vectors}
        for n in numbers[:-keep]:
            fs.delete(path(f"{self.path}/log/{n:012d}.json"), False)
        dropped = [s.getPath() for kind in ("segments", "vectors") for s in (fs.globStatus(path(f"{self.path}/{kind}/*")) or []) if s.getPath().getName() not in names]
        for folder in dropped:
            fs.delete(folder, True)
        return len(dropped)

    # -- reads ------------------------------------------------------------------------------

    def existing(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.snapshot().select("image_id"), "image_id", "left_semi")

    def page(self, offset: int = 0, limit: int = 100) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` in sequence order.

        The manifest's counts name the segments of the page; inside them ranges of sequence
        numbers are counted until those that hold the page are small enough to sort.
        """
        if offset < 0 or limit < 1:
            raise ValueError("offset must be >= 0 and limit >= 1")
        manifest = self.manifest()
        spans = [(s.first, s.last, s.live) for s in manifest.segments]
        low, high, skip, size = _span(spans, offset, limit)
        held = [s for s in manifest.segments if s.last >= low and s.first <= high]
        rows = self._live(manifest, held)
        while size > max(PAGE_ROWS, 2 * limit) and high - low >= PAGE_SLICES:
            step = -(-(high - low + 1) // PAGE_SLICES)
            part = F.floor((F.col("sequence") - low) / step).cast("long")
            counts = rows.filter(F.col("sequence").between(low, high)).groupBy(part.alias("part")).count().orderBy("part").collect()
            found = _span([(low + r.part * step, min(high, low + (r.part + 1) * step - 1), r["count"]) for r in counts], skip, limit)
            if found == (low, high, skip, size):
                break
            low, high, skip, size = found
        inside = rows.filter(F.col("sequence").between(low, high))
        return inside.orderBy("sequence").offset(skip).limit(limit).select("image_id", "x", "y", "w", "h", "created_at")


class _Nothing(Exception):
    """A change that would change nothing."""


def _useful(vectors, segments) -> tuple:
    """Vectors cut down to the segments that are still there."""
    names = {s.name for s in segments if s.live}
    cut = ((n, tuple(t for t in touched if t in names)) for n, touched in vectors)
    return tuple((n, touched) for n, touched in cut if touched)


def _span(spans: list[tuple[int, int, int]], offset: int, limit: int) -> tuple[int, int, int, int]:
    """First and last number of the ranges that hold a page, the rows to skip in them, and their rows."""
    before, held = 0, []
    for first, last, n in spans:
        if before + n > offset and before < offset + limit:
            held.append((first, last, n, before))
        before += n
    if not held:
        return 0, -1, 0, 0
    return held[0][0], held[-1][1], offset - held[0][3], sum(h[2] for h in held)


def identity_difference(have: DataFrame, want: DataFrame) -> DataFrame:
    a = have.select("name", F.col("value").alias("stored"))
    b = want.select("name", F.col("value").alias("expected"))
    return a.join(b, "name", "full_outer").filter(~F.col("stored").eqNullSafe(F.col("expected")))


def row_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Per column, how many rows of two tables disagree (missing rows count for every column)."""
    cols = [c for c in a.columns if c != key]
    j = a.select(F.col(key), *[F.col(c).alias("a_" + c) for c in cols]).join(
        b.select(F.col(key), *[F.col(c).alias("b_" + c) for c in cols]), key, "full_outer")
    return j.agg(*[F.sum((~F.col("a_" + c).eqNullSafe(F.col("b_" + c))).cast("long")).alias(c) for c in cols]).unpivot(
        [], cols, "column", "mismatches")


def feature_reference(namespace: str, *vectors: str):
    """Content key of a feature set: SHA-256 over the namespace and the values of every vector."""
    parts = [F.concat(F.lit(v + ":"), F.to_json(F.col(v))) for v in vectors]
    return F.sha2(F.concat_ws("|", F.lit(namespace), *parts).cast("binary"), 256)


def put_features(store: DataFrame | None, batch: DataFrame) -> DataFrame:
    """New rows of a content-addressed store: one per reference, leaving out those it already has."""
    new = batch.dropDuplicates(["feature_ref"])
    return new if store is None else new.join(store.select("feature_ref"), "feature_ref", "left_anti")


def ambiguous_tokens(store: DataFrame) -> DataFrame:
    """Projection tokens that stand for more than one full reference."""
    return store.groupBy("token").agg(F.countDistinct("feature_ref").alias("n_refs")).filter("n_refs > 1")


def collisions(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Content keys seen with different payloads."""
    return rows.groupBy(key).agg(F.countDistinct(payload).alias("n_payloads")).filter("n_payloads > 1")


def migrate(store: DataFrame, features: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """Re-key every observation to new features; ids, boxes and times stay.

    ``features`` maps ``feature_ref`` to ``new_emb``. Returns the new rows and the lineage
    (sequence, image_id, old_ref, new_ref). A reference without features fails.
    """
    j = store.join(features.select("feature_ref", "new_emb"), "feature_ref", "left")
    emb = F.when(F.col("new_emb").isNotNull(), F.col("new_emb")).otherwise(
        F.raise_error(F.concat(F.lit("no features for "), F.col("image_id"))).cast("array<float>"))
    moved = j.withColumn("new_emb", emb).withColumn("new_ref", feature_reference(namespace, "new_emb"))
    rows = moved.select("sequence", "image_id", "x", "y", "w", "h", F.col("new_emb").alias("emb"), F.col("new_ref").alias("feature_ref"), "created_at")
    return rows, moved.select("sequence", "image_id", F.col("feature_ref").alias("old_ref"), "new_ref")


def resolve_import(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Archive import: every manifest id must be valid, unique and match exactly one file, or nothing is imported."""
    names = files.select(F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "").alias("image_id"), "path", "length")
    j = manifest.join(names, "image_id", "left").withColumn("_n", F.count("path").over(Window.partitionBy("image_id")))
    listed = F.count(F.lit(1)).over(Window.partitionBy("image_id"))
    ok = valid_id(F.col("image_id")) & (F.col("_n") == 1) & (F.col("_l") == 1)
    return j.withColumn("_l", listed).withColumn("path", F.when(ok, F.col("path")).otherwise(
        F.raise_error(F.concat(F.lit("manifest id is invalid, repeated or has no single image: "), F.col("image_id"))))).drop("_n", "_l")


def export_bundle(store: DataFrame, path: str) -> DataFrame:
    """Write a backup with an inventory of per-row sizes and hashes; returns the inventory."""
    spark = store.sparkSession
    store.write.parquet(f"{path}/rows")
    inventory(spark.read.parquet(f"{path}/rows")).write.parquet(f"{path}/inventory")
    return spark.read.parquet(f"{path}/inventory")


def inventory(rows: DataFrame) -> DataFrame:
    body = F.to_json(F.struct(*[F.col(c) for c in COLUMNS]))
    return rows.select("sequence", F.octet_length(body).cast("long").alias("size"), F.sha2(body.cast("binary"), 256).alias("digest"))


def bundle_problems(spark: SparkSession, path: str) -> DataFrame:
    """Rows whose stored size or hash no longer match; empty for an intact bundle."""
    have = inventory(spark.read.parquet(f"{path}/rows"))
    want = spark.read.parquet(f"{path}/inventory")
    return row_differences(want, have, "sequence").filter("mismatches > 0")


def restore_bundle(spark: SparkSession, path: str, target: GalleryStore) -> int:
    """Restore into an empty store, keeping order and timestamps; a damaged bundle is refused."""
    if target.version:
        raise ValueError("restore needs an empty target")
    if bundle_problems(spark, path).limit(1).count():
        raise ValueError("bundle is damaged")
    return target.publish(spark.read.parquet(f"{path}/rows"))
