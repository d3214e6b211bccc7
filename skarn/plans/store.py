"""What is kept between calls: the memory of a vault, vectors, packed handles, and the one-row facts about an index.

Tables lie in numbered versions behind pointers (``sources.pointers``): a version
is complete before it is pointed to, and a crash leaves the one before.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn import schemas
from skarn.operators import graph, packing, structure
from skarn.plans.index import Index
from skarn.sources import notes, pointers, workspace

SCHEMA_VERSION = "2"
#: Shape of a handle: of code packs, of memory, and those that a pack's content names.
HANDLE = re.compile("(rh|mh|h)_[a-f0-9]{16}")
META = "schema_version string, digest string, rows long, written_at timestamp"
SEGMENTS = "handle string, seq int, ref string, text string, created_at timestamp"


@dataclass(frozen=True)
class Table:
    """A table in versions, each with a one-row meta table beside it."""

    spark: SparkSession
    folder: str
    schema: str

    def write(self, rows: DataFrame, digest: str = "") -> None:
        """Replace the table as a whole; the version before the last goes."""
        found = pointers.newest(self.spark, self.folder)
        number, version = (found[0] + 1 if found else 0), uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/{version}/rows")
        n = self.spark.read.parquet(f"{self.folder}/{version}/rows").count()
        meta = self.spark.range(1).select(F.lit(SCHEMA_VERSION), F.lit(digest), F.lit(n).cast("long"), F.current_timestamp()).toDF("schema_version", "digest", "rows", "written_at")
        meta.write.parquet(f"{self.folder}/{version}/meta")
        pointers.add(self.spark, self.folder, number, version)
        pointers.drop_before(self.spark, self.folder, number - 1)

    def _read(self, part: str, schema: str) -> DataFrame:
        found = pointers.newest(self.spark, self.folder)
        return self.spark.createDataFrame([], schema) if found is None else self.spark.read.schema(schema).parquet(f"{self.folder}/{found[1]}/{part}")

    def rows(self) -> DataFrame:
        return self._read("rows", self.schema)

    def meta(self) -> DataFrame:
        """The one-row facts alone; no row of the table is read.  Empty if nothing was written."""
        return self._read("meta", META)


class MemoryStore:
    """Notes of a vault and their vectors."""

    def __init__(self, spark: SparkSession, folder: str, vault: str):
        self.spark, self.vault = spark, vault
        self.notes = Table(spark, f"{folder}/notes", schemas.NOTES)
        self.vectors = Table(spark, f"{folder}/vectors", schemas.VECTORS)

    def _files(self) -> DataFrame:
        return notes.read_vault(self.spark, self.vault)

    def digest(self) -> str:
        """Of the vault's paths and contents, in the order of the paths."""
        rows = self._files().select("path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
        return workspace.manifest_hash(rows).first()["digest"]

    def sync(self) -> DataFrame:
        """Rebuild the notes from the vault.  Vectors are wiped: they may be of other texts."""
        rows = notes.normalise(notes.parse(self._files()))
        self.notes.write(_as(rows, schemas.NOTES), self.digest())
        self.vectors.write(self.spark.createDataFrame([], schemas.VECTORS))
        return self.notes.rows()

    def upsert(self, row: DataFrame) -> DataFrame:
        """Put one note in the place of that of its path; its vector goes if the content is another."""
        old = self.notes.rows()
        none = self.spark.createDataFrame([], "path string")
        now = structure.apply_delta(old, _as(row, schemas.NOTES), none, "path")
        meta = self.notes.meta().first()
        self.notes.write(graph.materialise(now), meta["digest"] if meta else "")
        kept = self.notes.rows().select("id", "content_hash")
        self.vectors.write(graph.materialise(self.vectors.rows().join(kept, ["id", "content_hash"], "left_semi").select(self.vectors.rows().columns)))
        return self.notes.rows()

    def embed(self) -> DataFrame:
        """Make the vectors that are missing or of another content; orphans go."""
        from skarn.plans.tools import embed_incremental

        rows = self.notes.rows()
        chunks = rows.select("id", F.concat_ws("\n", "title", "text").alias("chunk"), "content_hash")
        meta = self.notes.meta().first()
        self.vectors.write(graph.materialise(_as(embed_incremental(chunks, self.vectors.rows()), schemas.VECTORS)), meta["digest"] if meta else "")
        return self.vectors.rows()

    def status(self) -> dict[str, object]:
        """initialized, staleness (unknown before the first sync), notes, last_sync_at, embeddings_ready, schema_version."""
        meta = self.notes.meta().first()
        if meta is None:
            return {"initialized": False, "staleness": "unknown", "notes": 0, "last_sync_at": None, "embeddings_ready": False, "schema_version": None}
        made = self.vectors.meta().first()
        ready = made is not None and made["rows"] == meta["rows"] and made["digest"] == meta["digest"]
        return {"initialized": True, "staleness": "fresh" if meta["digest"] == self.digest() else "stale", "notes": meta["rows"], "last_sync_at": meta["written_at"], "embeddings_ready": ready, "schema_version": meta["schema_version"]}


def _as(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema``, cast; what ``rows`` lacks is null."""
    fields = rows.sparkSession.createDataFrame([], schema).schema.fields
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


class HandleStore:
    """Packed contents by handle."""

    def __init__(self, spark: SparkSession, folder: str):
        self.table = Table(spark, folder, SEGMENTS)

    def write(self, handle: str, segments: DataFrame, ttl_days: int = 7, most: int = 50) -> None:
        """Keep ``segments`` (seq, ref, text) under ``handle``; old handles and those beyond ``most`` go, this one never."""
        if not HANDLE.fullmatch(handle):
            raise ValueError(f"E_HANDLE_INVALID: {handle}")
        new = segments.select(F.lit(handle).alias("handle"), F.col("seq").cast("int").alias("seq"), "ref", "text", F.current_timestamp().alias("created_at"))
        rows = graph.materialise(self.table.rows().filter(F.col("handle") != handle).unionByName(new))
        heads = rows.groupBy("handle").agg(F.max("created_at").alias("created_at"))
        keep = structure.evict(heads, F.current_timestamp(), ttl_days, most, F.col("handle") == handle)
        self.table.write(rows.join(F.broadcast(keep.select("handle")), "handle", "left_semi"))  # ``most`` handles at most

    def read(self, handle: str) -> tuple[DataFrame | None, str, list[str]]:
        """Segments (None if there is no such handle), their reversibility and limitations; a segment without its text is left out and makes it partial."""
        if not HANDLE.fullmatch(handle):
            return None, "none", ["E_HANDLE_INVALID"]
        found = self.table.rows().filter(F.col("handle") == handle).orderBy("seq")
        whole = found.filter("ref is not null AND text is not null")
        n, good = found.count(), whole.count()
        if not n:
            return None, "none", []
        state = "none" if not good else "full" if good == n else "partial"
        lost = [f"W_SEGMENT_MISSING: {r['ref']}" for r in found.filter("ref is null OR text is null").limit(50).collect()]
        return whole.select("seq", "ref", "text"), state, lost


def index_meta(index: Index) -> DataFrame:
    """One row about an index: files, symbols, edges, imports, coverage by language, and the manifest's digest."""
    count = lambda t: getattr(index, t).agg(F.count("*").alias(t))
    per = index.symbols.groupBy("path").agg(F.count("*").alias("symbols"))
    by_file = index.files.join(per, "path", "left").select("language", (F.size("errors") > 0).alias("has_error"), F.coalesce("symbols", F.lit(0)).alias("symbols"))
    rows = structure.coverage(by_file).agg(F.map_from_entries(F.collect_list(F.struct("language", F.struct("eligible", "parsed", "failed", "symbols")))).alias("coverage"))
    digest = workspace.manifest_hash(index.files).withColumnRenamed("digest", "manifest_hash")
    out = count("files")
    for one in (count("symbols"), count("edges"), count("imports"), rows, digest):
        out = out.join(F.broadcast(one))  # one row each
    return out


def truncated(answer_rows: DataFrame, shown: int, order: list[str], ref: str) -> tuple[DataFrame, str | None, DataFrame | None]:
    """The first ``shown`` rows, and where there are more a handle of the whole list with its segments (seq, ref, text)."""
    rows = structure.positions(answer_rows, *order)
    if rows.count() <= shown:
        return rows.drop("position"), None, None
    segments = graph.materialise(rows.select(F.col("position").cast("int").alias("seq"), F.col(ref).alias("ref"), F.to_json(F.struct(*answer_rows.columns)).alias("text")))
    digest = segments.agg(packing.handle_of(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.sha2("text", 256).alias("t")))), lambda x: x["t"]), "")).alias("h"))
    return rows.filter(F.col("position") < shown).drop("position"), digest.first()["h"], segments
