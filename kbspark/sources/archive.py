"""Archived chunks, each content stored once whatever the number of snapshots that hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.sources.shared import exists
from kbspark.sources.writes import BUCKETS, bucket_of, of_schema, rewrite_stored, stored_rows

MEMBERS = "domain string, snapshot_id string, row_id string, copies long"


class ChunkArchive:
    """Snapshots of chunks below a folder, in two plain Parquet tables by buckets of tenants: ``rows`` has each different
    chunk row once, under a hash of all its columns, and ``members`` which snapshot has which rows.

    Adding a snapshot appends the rows that the archive lacks; a run that died and is repeated finds what it has
    appended before and adds the rest. Pruning drops memberships, then rows that no snapshot has any more.
    ``schema`` is that of the chunks, with ``domain``. Repeated rows: a number of copies. Nulls: values like any other.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets

    def _table(self, name: str, domains: DataFrame | None = None) -> DataFrame:
        schema = MEMBERS if name == "members" else f"{self.schema}, row_id string"
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return stored_rows(self.spark, f"{self.path}/{name}", schema, domains, self.buckets)

    def _append(self, rows: DataFrame, name: str) -> None:
        placed = rows.withColumn("bucket", bucket_of(F.col("domain"), self.buckets)).hint("rebalance", "bucket")
        placed.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def add(self, archived: DataFrame) -> None:
        """Store ``archived`` chunks (the schema's columns and ``snapshot_id``)."""
        columns = self.spark.createDataFrame([], self.schema).columns
        marked = of_schema(archived, f"{self.schema}, snapshot_id string").withColumn("row_id", F.sha2(F.to_json(F.struct(*columns)), 256))
        domains = archived.select("domain").distinct()
        known = self._table("rows", domains).select("domain", "row_id")
        # Rows go first: a membership never names a row that isn't there.
        self._append(marked.select(*columns, "row_id").dropDuplicates(["row_id"]).join(known, "row_id", "left_anti"), "rows")
        members = marked.groupBy("domain", "snapshot_id", "row_id").agg(F.count("*").alias("copies"))
        self._append(members.join(self._table("members", domains), ["snapshot_id", "row_id"], "left_anti").select("domain", "snapshot_id", "row_id", "copies"), "members")

    def archived(self, snapshots: DataFrame | None = None) -> DataFrame:
        """The archived chunks with their ``snapshot_id``, of all snapshots or of ``snapshots`` (domain, snapshot_id)."""
        domains = None if snapshots is None else snapshots.select("domain").distinct()
        members = self._table("members", domains)
        if snapshots is not None:
            members = members.join(snapshots.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
        each = members.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("snapshot_id", "row_id")
        return each.join(self._table("rows", domains), "row_id").drop("row_id")

    def prune(self, kept: DataFrame, result: str) -> None:
        """Keep the snapshots of ``kept`` (snapshot_id) alone; ``result`` is a folder of this run's own, the same if it is
        repeated."""
        stays = kept.select("snapshot_id").distinct()
        gone = self._table("members").join(stays, "snapshot_id", "left_anti").select("domain").distinct()
        if not exists(self.spark, f"{result}/domains/_SUCCESS"):
            gone.write.mode("overwrite").parquet(f"{result}/domains")
        domains = self.spark.read.parquet(f"{result}/domains")
        if domains.isEmpty():
            return
        rewrite_stored(self.spark, f"{self.path}/members", MEMBERS, domains, lambda m: m.join(stays, "snapshot_id", "left_semi"), f"{result}/members", self.buckets)
        used = self._table("members", domains).select("row_id").distinct()
        rewrite_stored(self.spark, f"{self.path}/rows", f"{self.schema}, row_id string", domains, lambda r: r.join(used, "row_id", "left_semi"), f"{result}/rows", self.buckets)

    def counts(self) -> DataFrame:
        """``(domain, rows, members)``: stored rows and rows of all snapshots."""
        rows = self._table("rows").groupBy("domain").agg(F.count("*").alias("rows"))
        return rows.join(self._table("members").groupBy("domain").agg(F.sum("copies").alias("members")), "domain", "left").fillna(0)
