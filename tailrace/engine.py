"""What the service offers, over a folder of parquet tables: sources, discovery, health, and the batch stages."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace import schemas
from tailrace.operators import classify, dedup, documents


class DuplicateSource(ValueError):
    """A source of that name exists."""


def stable_id(*parts: str) -> str:
    h = hashlib.md5("\0".join(parts).encode(), usedforsecurity=False).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


@dataclass
class Engine:
    spark: SparkSession
    root: str
    now: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def table(self, name: str) -> DataFrame:
        """A table of the folder; an empty one of its schema where it isn't there yet."""
        path = f"{self.root}/{name}.parquet"
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.read.parquet(path)
        return self.spark.createDataFrame([], schemas.TABLES[name])

    def append(self, name: str, rows: DataFrame) -> None:
        known = self.table(name).schema
        rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in known]).write.mode("append").parquet(f"{self.root}/{name}.parquet")

    def create_source(self, name: str, kind: str, uri: str | None = None) -> str:
        if not self.table("sources").filter(F.col("name") == name).isEmpty():
            raise DuplicateSource(name)
        id_ = stable_id("source", name)
        self.append("sources", self.spark.createDataFrame([(id_, name, kind, uri, True, self.now, self.now)], schemas.TABLES["sources"]))
        return id_

    def discover(self, source_id: str, url: str) -> str:
        """The id of the document at ``url``, made if it isn't known; asking again changes nothing."""
        known = self.table("source_documents").filter(F.col("url") == url).select("id").head()
        if known:
            return known["id"]
        id_ = stable_id("document", url)
        row = self.spark.createDataFrame([(id_, source_id, hashlib.sha256(url.encode()).hexdigest(), None, None, url, "discovered", None, None, self.now)], schemas.TABLES["source_documents"])
        self.append("source_documents", row)
        return id_

    def health(self) -> dict[str, str]:
        """``ok`` or what went wrong, for the cluster and for the folder."""
        out = {}
        for name, ask in (("spark", lambda: self.spark.range(1).count()), ("tables", lambda: self.table("sources").limit(1).count())):
            try:
                ask()
                out[name] = "ok"
            except Exception as e:  # noqa: BLE001 - a probe reports whatever happens
                out[name] = type(e).__name__
        return out

    def process(self) -> dict[str, DataFrame]:
        """Parse, deduplicate, promote and classify all documents; promotion comes before classification, so that no incident is missed."""
        docs = self.table("source_documents")
        parsed = documents.parse(docs).filter("status = 'parsed'").select("id")
        ready = docs.join(parsed, "id", "left_semi")
        sigs = dedup.signatures(ready)
        dup = dedup.near_duplicates(sigs, ready.select(F.col("id").alias("document_id"), F.struct("created_at", "id").alias("seq")))
        status = dedup.dedup_status(ready, dup)
        incidents = documents.promote(ready.join(status.filter("status = 'deduped'").select(F.col("document_id").alias("id")), "id", "left_semi"))
        shaped = incidents.withColumn("id", F.col("document_id")).withColumn("sections", F.lit(None).cast("array<struct<name:string,text:string>>"))
        labels = classify.classify_incidents(shaped, self.table("incident_labels"))
        return {"parsed": parsed, "status": status, "incidents": incidents, "labels": labels}
