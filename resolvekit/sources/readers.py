"""Reading rankings, discoveries and event lakes; appending and publishing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.exprs import blank_to_null, content_id, id_from_url, name_key
from ..operators.quality import table_digest

#: Header names of a ranking, and of the nine columns of a discovery file.
RANKING_ALIASES = {"rank": ("rank", "ranking"), "name": ("artist_name", "artist", "name"), "value": ("monthly_listeners", "listeners", "value")}
DISCOVERY_COLUMNS = {
    "source_type": ("source_type", "sourceType"), "source_name": ("source_name", "sourceName"),
        "source_record_id": ("source_record_id", "sourceRecordId"), "source_url": ("source_url", "sourceUrl"),
    "raw_name": ("raw_artist_name", "rawArtistName", "name"), "spotify_id": ("spotify_artist_id", "spotifyArtistId"),
        "spotify_url": ("spotify_artist_url", "spotifyArtistUrl"),
    "discovered_at": ("discovered_at", "discoveredAt"), "asserted_id": ("asserted_id", "assertedId"),
}
SPOTIFY_ID = "^[A-Za-z0-9]{22}$"


def _alias(df: DataFrame, aliases: dict[str, tuple[str, ...]], required: tuple[str, ...]) -> DataFrame:
    header = {c.strip().lstrip("\ufeff").lower(): c for c in df.columns}
    out = []
    for name, options in aliases.items():
        found = [header[o.lower()] for o in options if o.lower() in header]
        if len(found) > 1 or (not found and name in required):
            raise ValueError(f"column {name}: {'several' if found else 'no'} headers match {options}")
        out.append((F.col(f"`{found[0]}`") if found else F.lit(None).cast("string")).alias(name))
    return df.select(*out, *(c for c in ("_file", "_row") if c in df.columns))


def read_ranking_csv(spark: SparkSession, path: str, aliases: dict = RANKING_ALIASES) -> DataFrame:
    """(rank, name, value, name_key, file, source_row) of a quoted CSV whose header uses any of the aliases; a header that matches twice is an error.

    A file with line breaks in its fields can't be split, so a task reads it whole and source_row counts its rows from 1.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    raw = raw.withColumn("_file", F.input_file_name()).withColumn("_at", F.monotonically_increasing_id())
    raw = raw.withColumn("_row", F.row_number().over(Window.partitionBy("_file").orderBy("_at")).cast("long")).drop("_at")
    df = _alias(raw, aliases, ("rank", "name"))
    return df.select(F.trim("rank").try_cast("long").alias("rank"), blank_to_null("name").alias("name"),
        F.regexp_replace("value", ",", "").try_cast("long").alias("value"), name_key("name").alias("name_key"), F.col("_file").alias("file"),
            F.col("_row").alias("source_row"))


def normalise_discoveries(df: DataFrame, columns: dict[str, tuple[str, ...]] = DISCOVERY_COLUMNS) -> DataFrame:
    """Discoveries with the nine columns under any of their names, ids taken from URLs where they are missing, and `faults`."""
    df = _alias(df, columns, ("raw_name",))
    df = df.select(*(blank_to_null(F.col(c).cast("string")).alias(c) for c in columns))
    of_url = id_from_url("spotify_url", r"open\.spotify\.com/artist/([A-Za-z0-9]{22})")
    df = df.withColumn("_url_id", of_url).withColumn("faults", F.array_compact(F.array(
        F.when(F.col("raw_name").isNull(), "name_missing"), F.when(F.col("source_type").isNull(), "source_type_missing"),
            F.when(F.try_to_timestamp("discovered_at").isNull(), "discovered_at_invalid"),
        F.when(F.col("spotify_id").isNotNull() & ~F.col("spotify_id").rlike(SPOTIFY_ID), "spotify_id_invalid"),
            F.when((F.col("spotify_id") != F.col("_url_id")), "spotify_id_and_url_differ"),
    )))
    df = df.withColumn("spotify_id", F.coalesce("spotify_id", "_url_id")).drop("_url_id").withColumn("discovered_at", F.try_to_timestamp("discovered_at"))
    return df.withColumn("name_key", name_key("raw_name")).withColumn("discovery_id",
        content_id("source_name", "source_record_id", "source_type", "name_key", "spotify_id"))


def read_discoveries(spark: SparkSession, path: str, columns: dict[str, tuple[str, ...]] = DISCOVERY_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) of a CSV file, or of JSON: an array, or an object with `discoveries`."""
    if path.lower().endswith(".csv"):
        raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    else:
        raw = spark.read.option("primitivesAsString", True).json(path, multiLine=True)
        if "discoveries" in raw.columns:
            raw = raw.select(F.explode("discoveries").alias("d")).select("d.*")
    df = normalise_discoveries(raw, columns)
    return df.where(F.size("faults") == 0).drop("faults"), df.where(F.size("faults") > 0)


def read_event_lake(spark: SparkSession, root: str, schema: str, glob: str = "*.json", multi_line: bool = True) -> DataFrame:
    """All JSON documents below a folder (one a file, or one a line), with the file each came from; the schema is given, never inferred."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("multiLine",
        multi_line).json(root).withColumn("file", F.col("_metadata.file_path"))


#: Kind of artifact -> its column -> where the value stands in the JSON document, and its type.
ARTIFACTS = {
    "runs": {"run_id": ("runId", "string"), "revision": ("revision", "bigint"), "status": ("control.status", "string"),
        "stop_reason": ("control.stopReason", "string"), "last_phase": ("lastCompletedPhase", "string"), "started_at": ("startedAt", "timestamp"),
            "completed_at": ("completedAt", "timestamp")},
    "events": {"event_id": ("eventId", "string"), "candidate_id": ("candidateId", "string"), "event_type": ("eventType", "string"),
        "previous_state": ("previousState", "string"), "next_state": ("nextState", "string"), "candidate_revision": ("candidateRevision", "bigint"),
            "reason_code": ("reasonCode", "string"), "occurred_at": ("occurredAt", "timestamp")},
    "occurrences": {"occurrence_id": ("occurrenceId", "string"), "provider": ("provider", "string"), "source_type": ("sourceType", "string"),
        "source_name": ("sourceName", "string"), "source_record_id": ("sourceRecordId", "string"), "raw_name": ("artist.rawName", "string"),
            "entity_type": ("providerEntity.type", "string"), "entity_id": ("providerEntity.id", "string"), "discovered_at": ("discoveredAt", "timestamp")},
    "associations": {"association_id": ("associationId", "string"), "occurrence_id": ("occurrenceId", "string"),
        "target_type": ("targetType", "string"), "target_id": ("targetId", "string"), "created_at": ("createdAt", "timestamp")},
    "checkpoints": {"checkpoint_id": ("checkpointId", "string"), "revision": ("revision", "bigint"), "provider": ("provider", "string"),
        "source_name": ("sourceName", "string"), "page": ("position.page", "bigint"), "item_offset": ("position.itemOffset", "bigint"),
            "updated_at": ("updatedAt", "timestamp")},
    "evidence": {"evidence_id": ("evidenceId", "string"), "artist_id": ("musicRollArtistId", "string"), "evidence_type": ("evidenceType", "string"),
        "source_class": ("sourceClass", "string"), "observed_at": ("observedAt", "timestamp"), "review_status": ("reviewStatus", "string")},
}


def _schema_of(columns: dict[str, tuple[str, str]]) -> str:
    """DDL of the documents that hold these places."""
    top: dict[str, dict[str, str] | str] = {}
    for path, kind in columns.values():
        name, _, field = path.partition(".")
        if field:
            top.setdefault(name, {})[field] = kind
        else:
            top[name] = kind
    return ", ".join(f"`{k}` {v}" if isinstance(v, str) else f"`{k}` struct<{', '.join(f'`{a}`: {b}' for a, b in v.items())}>" for k, v in top.items())


def read_artifacts(spark: SparkSession, root: str, kind: str, glob: str = "*.json", multi_line: bool = True) -> DataFrame:
    """The artifacts of a kind below root/kind as a table with the columns of ARTIFACTS and the file of each; what a document lacks is null."""
    columns = ARTIFACTS[kind]
    raw = read_event_lake(spark, f"{root}/{kind}", _schema_of(columns), glob, multi_line)
    return raw.select(*(F.col(path).alias(name) for name, (path, _) in columns.items()), "file")


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, collisions) for an append that is inert when repeated.

    Of equal keys in incoming one row goes on. A key that exists, or comes twice, with different content is a collision.
    """
    rest = [c for c in incoming.columns if c != key]
    mark = F.xxhash64(*rest)
    batch = incoming.withColumn("_h", mark)
    own = batch.groupBy(key).agg(F.countDistinct("_h").alias("n"), F.min(F.struct("_h", *rest)).alias("r"))
    old = existing.select(key, F.xxhash64(*rest).alias("_old")).distinct()
    bad = own.where("n > 1").select(key).unionByName(batch.join(old, key).where("_h <> _old").select(key)).distinct()
    new = own.select(key, *(F.col(f"r.{c}").alias(c) for c in rest)).join(old.select(key).distinct(), key, "left_anti")
    return new.join(bad, key, "left_anti").select(*incoming.columns), bad


def build_snapshot(records: DataFrame, snapshot_id: str, path: str | None = None, source: str | None = None, key: str | None = None) -> DataFrame:
    """One row about a snapshot: rows, digest of the records, distinct and blank names, repeated keys.

    With a path the records are written there, a partition for each snapshot; each carries its source and the digest
    of the records that it was made with.
    """
    about = table_digest(records)
    repeated = records.groupBy(key).count().where("count > 1").agg(F.count("*").alias("repeated_ids")) if key else None
    checks = records.agg(F.count_if(F.col("name").isNull()).alias("blank_names"), F.countDistinct("name").alias("names"))
    about = about.crossJoin(checks)
    about = (about.crossJoin(repeated) if key else about.withColumn("repeated_ids", F.lit(None).cast("long"))).withColumn("snapshot_id",
        F.lit(snapshot_id)).withColumn("source", F.lit(source))
    if path is not None:
        stamped = records.crossJoin(F.broadcast(about.select(F.col("digest").alias("input_digest"), "source", "snapshot_id")))  # one row
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)
    return about
