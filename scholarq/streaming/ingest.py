"""Incremental ingest of entity-annotation files (C1) with Structured
Streaming.

The reference rebuilds its index on every start and keeps adding to the
counts.  Here the file source remembers (in its checkpoint) which files it
has ingested; each micro-batch maps files to papers, counts mentions per
(paper, entity) and merges into the ``entities`` and
``papers_have_entities`` tables: entities are inserted-or-ignored (hash
ids), and a re-ingested paper's link rows are replaced.  A file that is not
valid (e.g. cut short) changes nothing and goes to the rejects with its
reason, as does a file of no known paper; rejects accumulate.  A file without
a byte never reaches a stream of Spark; ``sources.files.empty_files`` lists those.

The merges are idempotent and entities are committed before the links
that name them, so a micro-batch replayed after a failure leaves the same
tables (exactly-once in effect).  ``trigger(availableNow=True)`` processes
what is there and stops; a long-running trigger works the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from scholarq.operators.merge import BucketedTable, VersionedTable, replace_counts
from scholarq.operators.mentions import build_mention_index, check_unique_ids
from scholarq.schemas import ENTITIES, PAPERS_HAVE_ENTITIES
from scholarq.sources.files import entity_texts, parse_entity_records

REJECTS = T.StructType([T.StructField("file_name", T.StringType()), T.StructField("reason", T.StringType())])


def entity_file_stream(spark: SparkSession, ents_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """(file_name, paper_pdf, entities, malformed) of each new file."""
    r = spark.readStream
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return parse_entity_records(entity_texts(r, ents_dir, per_line=False))


def entities_table(spark: SparkSession, tables_root: str) -> BucketedTable:
    return BucketedTable(spark, f"{tables_root}/entities", ENTITIES, ["entity_id"])


def links_table(spark: SparkSession, tables_root: str) -> BucketedTable:
    return BucketedTable(spark, f"{tables_root}/papers_have_entities", PAPERS_HAVE_ENTITIES, ["paper_id"])


def rejects_table(spark: SparkSession, tables_root: str) -> VersionedTable:
    return VersionedTable(spark, f"{tables_root}/rejected_files", REJECTS)


def merge_mentions(batch: DataFrame, papers: DataFrame, entities_tbl: BucketedTable,
                   phe_tbl: BucketedTable, rejects_tbl: VersionedTable | None = None) -> None:
    """One micro-batch: files -> papers (by entity-file name), counts, merges.
    Only the buckets of the batch's entities and papers are read and rewritten."""
    batch = batch.persist()  # three commits read it
    try:
        keyed = papers.select("paper_id", F.element_at(F.split("paper_entities", "/"), -1).alias("file_name"))
        if rejects_tbl is not None:
            unmatched = (batch.filter("not malformed").join(keyed, "file_name", "left_anti")
                         .select("file_name", F.lit("no such paper").alias("reason")))
            malformed = batch.filter("malformed").select("file_name", F.lit("malformed").alias("reason"))
            fresh = unmatched.unionByName(malformed).distinct().join(rejects_tbl.read(), ["file_name", "reason"], "left_anti")
            if not fresh.isEmpty():
                rejects_tbl.append(fresh)
        # Only a parsed file speaks about its paper; an empty list clears its links.
        matched = batch.filter("not malformed").join(keyed, "file_name")
        raw = matched.select("paper_id", F.explode("entities").alias("m")).select(
            "paper_id", F.col("m.text").alias("entity_name"), F.col("m.label").alias("entity_type"))
        new_entities, counts = build_mention_index(raw)

        def with_new(old: DataFrame) -> DataFrame:
            known = old.select("entity_type", "entity_name")
            ents = old.unionByName(new_entities.join(known, ["entity_type", "entity_name"], "left_anti"))
            # Two names with one hash id would merge their links silently: refuse the batch.
            if not check_unique_ids(ents).isEmpty():
                raise ValueError("two entities share a hash id")
            return ents

        entities_tbl.rewrite(new_entities, with_new)
        emptied = matched.select("paper_id").distinct().join(counts.select("paper_id"), "paper_id", "left_anti")
        phe_tbl.rewrite(matched, lambda old: replace_counts(old.join(emptied, "paper_id", "left_anti"), counts))
    finally:
        batch.unpersist()


def start_entity_ingest(spark: SparkSession, ents_dir: str, papers: DataFrame, tables_root: str,
                        checkpoint_location: str, available_now: bool = True) -> StreamingQuery:
    """Start the ingest; tables are ``<tables_root>/entities`` and
    ``<tables_root>/papers_have_entities`` (plus ``rejected_files``)."""
    tables = [t(spark, tables_root) for t in (entities_table, links_table, rejects_table)]
    w = (entity_file_stream(spark, ents_dir).writeStream
         .foreachBatch(lambda df, _epoch: merge_mentions(df, papers, *tables))
         .option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
