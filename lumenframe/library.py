"""The engine: one object with the operations that an application calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import aesthetic_score, read_head
from .operators import catalog, decisions, dedup, near, scoring, search, sessions, views
from .scratch import forget, materialise
from .sources import images as pictures
from .sources.store import Store
from .sources.walk import listed, walk
from .streaming.incremental import next_id

GRID_LIMIT, SEARCH_LIMIT = 2000, 60


class Library:
    """A catalog below a folder. Every result is a DataFrame; every change is a new snapshot."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)
        self.embedder: pictures.Embedder | None = None
        self.head: tuple[list[float], float] | None = None
        self.weights = scoring.Weights()
        self.local = True

    def _t(self, name: str) -> DataFrame:
        return self.store.table(name)

    # --- scanning ---

    def scan(self, root: str, local: bool = True, analyse: bool = True) -> dict[str, int]:
        """Bring the catalog up to date with the files below root; the counts of what was done.

        Files are compared by size and time. Contents are hashed in full only where size and the hash of the first
        4096 bytes leave a choice; others get their hash when they are analysed.
        """
        found = walk(self.spark, root) if local else listed(self.spark, root)
        seen = materialise(found, "walk")
        errors = seen.where("path is null").count()
        both = materialise(catalog.compared(self._t("files"), seen.where("path is not null"), root), "compared")
        counts = {r.outcome: r.files for r in catalog.reconcile_counts(both).collect()}
        self.store.put(files=catalog.reconciled(both, next_id(self.store)), images=catalog.without_changed(self._t("images"), both), embeddings=catalog.without_changed(self._t("embeddings"), both))
        out = {k: counts.get(k, 0) for k in ("added", "updated", "revived", "unchanged", "missing")} | {"errors": errors, "found": sum(counts.get(k, 0) for k in ("added", "updated", "revived", "unchanged"))}
        self.local = local
        out["hashed"] = self._hash_candidates(root)
        if analyse:
            out["analyzed"], out["embedded"] = self._analyse(root), self._embed(root)
        return out

    def _read(self, root: str, wanted: DataFrame, most: int = -1) -> DataFrame:
        """(path, content) of the wanted files (path); of local ones only so many bytes."""
        if self.local:
            return pictures.local_contents(wanted, most)
        return pictures.contents(self.spark, root).join(wanted.select("path"), "path", "left_semi")

    def _hash_candidates(self, root: str) -> int:
        files = self._t("files")
        same_size = dedup.size_candidates(files)
        todo = same_size.where("content_hash is null")
        if not todo.take(1):
            return 0
        prefixes = materialise(pictures.hashed(self._read(root, same_size, pictures.PREFIX_BYTES)).select("path", "prehash"), "prefixes")
        chosen = dedup.prefix_candidates(files.join(prefixes, "path", "left")).select("id", "path")
        hashes = materialise(pictures.hashed(self._read(root, chosen)).join(chosen, "path").select("id", "content_hash"), "hashes")
        self.store.put(files=catalog.with_hashes(files, hashes))
        return hashes.count()

    def _analyse(self, root: str) -> int:
        todo = materialise(catalog.needing_analysis(self._t("files"), self._t("images")).select("id", "path"), "todo")
        if not todo.take(1):
            return 0
        facts = pictures.file_facts(self._read(root, todo))
        seen = materialise(pictures.picture_facts(pictures.decoded(self.spark, root, todo)), "pictures")
        rows = todo.join(facts, "path", "left").join(seen.drop("picture"), "path", "left")
        thumb = F.when(F.col("width").isNotNull(), pictures.thumb_path(f"{self.store.path}/thumbs", F.col("content_hash")))
        new = materialise(rows.withColumn("thumb_path", thumb).withColumnRenamed("id", "file_id"), "facts")
        files = catalog.with_hashes(self._t("files"), new.select(F.col("file_id").alias("id"), "content_hash").where("content_hash is not null"))
        done = new.select(F.col("file_id").alias("id"), F.lit(True).alias("__done"))
        files = files.join(done, "id", "left").withColumn("status", F.when(F.col("__done") & (F.col("status") != "missing"), "analyzed").otherwise(F.col("status"))).drop("__done")
        pictures.write_thumbnails(pictures.thumbnails(seen, new.select("path", "content_hash"), f"{self.store.path}/thumbs"), f"{self.store.path}/thumbs")
        self.store.put(files=files, images=catalog.upserted(self._t("images"), new.drop("path", "content_hash"), "file_id"))
        forget(seen)
        return new.count()

    def _embed(self, root: str) -> int:
        if self.embedder is None:
            return 0
        todo = catalog.needing_embedding(self._t("files"), self._t("images"), self._t("embeddings")).select("file_id")
        paths = self._t("files").select(F.col("id").alias("file_id"), "path").join(todo, "file_id", "left_semi")
        raw = pictures.decoded(self.spark, root, paths)
        new = materialise(pictures.embedded(raw, self.embedder).join(paths, "path").select("file_id", "vector"), "vectors")
        self.store.put(embeddings=catalog.upserted(self._t("embeddings"), new, "file_id"))
        if self.head is not None:
            scored = new.select("file_id", aesthetic_score(F.col("vector"), *self.head).alias("aesthetic_score"))
            self.store.put(images=catalog.with_values(self._t("images"), scored, "file_id"))
        return new.count()

    # --- duplicates and clusters ---

    def dupes(self) -> DataFrame:
        return dedup.ordered_groups(self._t("files"))

    def _replace(self, kind: str, members: DataFrame) -> DataFrame:
        new = materialise(catalog.clusters_replaced(self._t("clusters"), kind, members), "clusters")
        signals = self._t("images").select(
            F.col("file_id").alias("id"), "sharpness", F.col("exposure_score").alias("exposure"), F.col("aesthetic_score").alias("aesthetic"),
            "face_count", "eyes_open_ratio", (F.col("width").cast("long") * F.col("height")).alias("pixels"),
        )
        scored = materialise(scoring.scores(new.select("cluster_id", F.col("file_id").alias("id")).join(signals, "id", "left"), self.weights), "scores")
        quality = scoring.current_quality(scored).select(F.col("id").alias("file_id"), F.col("quality").alias("quality_score"))
        self.store.put(clusters=new, keepers=scoring.keepers(scored), images=catalog.with_values(self._t("images").withColumn("quality_score", F.lit(None).cast("double")), quality, "file_id"))
        return self.clusters(kind)

    def cluster_near(self, dhash_bits: int = near.DHASH, phash_bits: int = near.PHASH) -> DataFrame:
        own = near.representatives(self._t("files"), self._t("images")).select(F.col("file_id").alias("id"), "dhash", "phash")
        return self._replace("near", near.near_clusters(materialise(own, "hashes"), dhash_bits, phash_bits).select("cluster_id", "file_id"))

    def cluster_bursts(self, gap: int = sessions.BURST_GAP, least_cosine: float = sessions.BURST_COSINE) -> DataFrame:
        own = near.representatives(self._t("files"), self._t("images")).join(self._t("embeddings"), "file_id", "left")
        frames = own.select(F.col("file_id").alias("id"), "camera", F.col("captured_at").alias("at"), "vector")
        found = sessions.bursts(frames, gap, least_cosine)
        return self._replace("burst", materialise(found.select(F.col("burst").alias("cluster_id"), F.col("id").alias("file_id")), "bursts"))

    def clusters(self, kind: str | None = None) -> DataFrame:
        listing = views.cluster_listing(self._t("clusters"), self._t("files"), self._t("images"), kind)
        return views.listing_order(listing.join(self._t("keepers"), "cluster_id", "left"))

    def best_of(self, gap: int = sessions.EVENT_GAP) -> DataFrame:
        rows = views.grid(self._t("files"), self._t("images")).where("captured_at is not null").select("file_id", "path", F.col("captured_at").alias("at"), F.col("quality_score").alias("quality"))
        more = self._t("images").select("file_id", F.col("aesthetic_score").alias("aesthetic"), "sharpness")
        best = sessions.best_of(rows.join(more, "file_id").withColumnRenamed("file_id", "id"), gap)
        return best.join(rows.select(F.col("file_id").alias("id"), "path"), "id").orderBy("event")

    # --- lookups ---

    def files_for_hashes(self, hashes: list[str]) -> DataFrame:
        asked = self.spark.createDataFrame(list(enumerate(hashes)), "pos long, hash string")
        return views.files_for_hashes(asked, self._t("files")).orderBy("pos")

    def grid_items(self, offset: int = 0, limit: int = GRID_LIMIT) -> DataFrame:
        return views.grid_page(self._t("files"), self._t("images"), offset, limit)

    def images_needing_faces(self) -> DataFrame:
        return catalog.needing_faces(self._t("files"), self._t("images"))

    def store_face_facts(self, facts: DataFrame) -> None:
        """facts: (file_id, face_count, eyes_open_ratio)."""
        self.store.put(images=catalog.with_values(self._t("images"), facts, "file_id"))

    def stats(self) -> DataFrame:
        return views.library_stats(self._t("files"), self._t("images"), self._t("embeddings"))

    # --- models and search ---

    def attach_models(self, embedder: pictures.Embedder, head: bytes | None = None) -> None:
        self.embedder, self.head = embedder, read_head(head) if head is not None else None

    def has_models(self) -> bool:
        return self.embedder is not None

    def search(self, text: str, limit: int = SEARCH_LIMIT, since: int | None = None, until: int | None = None, camera: str | None = None) -> DataFrame:
        if self.embedder is None:
            raise RuntimeError("no models are attached")
        return search.search(self._t("files"), self._t("images"), self._t("embeddings"), list(self.embedder.text(text)), limit, since, until, camera)

    # --- decisions ---

    def decide(self, content_hash: str, state: str, at: int) -> None:
        new = self.spark.createDataFrame([(content_hash, state, at)], "content_hash string, state string, decided_at long")
        self.store.put(decisions=decisions.decided(self._t("decisions"), new))

    def undo(self, content_hash: str) -> None:
        self.store.put(decisions=decisions.undone(self._t("decisions"), self.spark.createDataFrame([(content_hash,)], "content_hash string")))

    def accept_defaults(self) -> None:
        self.store.put(resolutions=materialise(decisions.defaults_accepted(self._t("files"), self._t("resolutions")), "resolutions"))

    def rejects(self) -> DataFrame:
        return decisions.rejects(self._t("files"), self._t("decisions"), self._t("resolutions")).orderBy("path")

    def staging_manifest(self, folder: str) -> str:
        """The plan for moving the rejects, as JSON. Nothing is moved. The list passes through the driver."""
        return decisions.manifest([r.path for r in self.rejects().toLocalIterator()], folder)
