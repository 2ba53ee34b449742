"""Local (entity-index) search with fallback tiers, shaping and relevance.

TOP4 (person/organisation fallbacks), FLT11, REL1, PRJ2, PRJ3, PRJ6, TOP5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarq.functions.entities import check_limit, label_for, normalised_type
from scholarq.operators.mentions import Clause, mention_like_papers, mention_rows, mention_search
from scholarq.operators.tiers import first_nonempty


def _parts_tier(papers, phe, entities, label: str, parts: list[str], limit: str) -> DataFrame:
    """Rows for any of ``parts`` (type ``label``), one row per paper, first
    part wins (the fallback's "skip papers already listed" rule).  Both
    picks are ``min_by`` aggregates (partial per task), not windows, so a
    part or paper holding many rows never lands in one task."""
    if not parts:
        return mention_rows(papers, phe, entities).limit(0)
    arr = F.array(*[F.lit(p) for p in parts])
    ents = entities.filter((F.col("entity_type") == F.lit(label)) & F.col("entity_name").isin(parts))
    rows = mention_rows(papers, phe, ents).withColumn("_part", F.array_position(arr, F.col("entity_name")))
    cols = [c for c in rows.columns if c not in ("_part",)]
    if limit == "one":  # each per-part query is limited on its own
        rows = (rows.groupBy("_part")
                .agg(F.min_by(F.struct(*cols), F.struct("paper_id", "entity_name", "entity_type")).alias("_r"))
                .select("_part", "_r.*"))
    first = (rows.groupBy("paper_id")
             .agg(F.min_by(F.struct(*[c for c in cols if c != "paper_id"]),
                           F.struct("_part", "entity_name", "entity_type")).alias("_r"))
             .select("paper_id", "_r.*"))
    return first.select(*cols)


def person_search(papers, phe, entities, name: str, limit: str = "all") -> DataFrame:
    """Exact person name; if nothing and the name has a space, each name
    part of >= 3 characters (FLT11)."""
    check_limit(limit)
    tiers = [lambda: mention_search(papers, phe, entities, [Clause("person", name)], limit=limit)]
    if " " in name:
        parts = [p for p in name.split() if len(p) >= 3]
        tiers.append(lambda: _parts_tier(papers, phe, entities, "PERSON", parts, limit))
    return first_nonempty(tiers)


def organisation_search(papers, phe, entities, name: str, limit: str = "all") -> DataFrame:
    """Exact organisation; then words longer than 3 characters (only for
    names with a space); then a case-insensitive substring match."""
    check_limit(limit)
    tiers = [lambda: mention_search(papers, phe, entities, [Clause("organisation", name)], limit=limit)]
    if " " in name:
        words = [w for w in name.split() if len(w) > 3]
        tiers.append(lambda: _parts_tier(papers, phe, entities, "ORG", words, limit))
    tiers.append(lambda: mention_like_papers(papers, phe, entities, name, "ORG")
                 .withColumn("entity_id", F.lit(None).cast("long"))
                 .withColumn("entity_name", F.lit(None).cast("string"))
                 .withColumn("entity_type", F.lit(None).cast("string"))
                 .withColumn("count", F.lit(None).cast("long")))
    return first_nonempty(tiers)


def local_search(papers, phe, entities, entity_type: str, name: str, limit: str = "all") -> DataFrame:
    """Dispatch by requested type (person / organisation / work)."""
    t = entity_type.lower()
    label_for(t)
    if t == "person":
        return person_search(papers, phe, entities, name, limit)
    if t in ("organisation", "organization"):
        return organisation_search(papers, phe, entities, name, limit)
    return mention_search(papers, phe, entities, [Clause(t, name)], limit=limit)


def shape_local_results(rows: DataFrame, entity_type: str, name: str,
                        doc_text: DataFrame | None = None) -> DataFrame:
    """PRJ2/PRJ3/PRJ6 + REL1 relevance, sorted by relevance (TOP5).

    ``doc_text`` is (paper_id, text); a paper without text scores 0.3 when
    the name has to be looked up in the text.
    """
    t = entity_type.lower()
    q = name.lower()
    out = rows.select(
        F.lit("local").alias("source"),
        "paper_id",
        F.col("paper_name").alias("title"),
        "paper_name",
        F.col("paper_pdf").alias("pdf_path"),
        F.col("paper_docx").alias("docx_path"),
        F.col("paper_json").alias("json_path"),
        F.col("paper_entities").alias("entities"),
        F.coalesce(F.col("entity_name"), F.lit(name)).alias("entity_name"),
        normalised_type(F.col("entity_type"), t).alias("entity_type"),
        F.col("entity_name").alias("_matched"),
    )
    if t == "person":
        if doc_text is not None:
            # Only a flag per paper leaves the text scan: texts are
            # semi-joined with the result's paper ids (AQE broadcasts the
            # ids when the result is small), so no text is shuffled.
            need = out.select("paper_id").distinct()
            found = (doc_text.join(need, "paper_id", "left_semi")
                     .select("paper_id", (F.instr(F.lower(F.col("text")), q) > 0).alias("_found")))
            out = out.join(found, "paper_id", "left")
        else:
            out = out.withColumn("_found", F.lit(None).cast("boolean"))
        e = F.lower(F.coalesce(F.col("_matched"), F.lit("")))
        rel = (F.when(e == F.lit(q), 1.0)
               .when((F.instr(e, q) > 0) | (F.instr(F.lit(q), e) > 0), 0.8)
               .when(F.col("_found").isNull(), 0.3)
               .when(F.col("_found"), 0.6)
               .otherwise(0.4))
        out = out.withColumn("relevance_score", rel).drop("_found")
    else:
        out = out.withColumn("relevance_score", F.lit(1.0))
    return sort_by_relevance(out.drop("_matched"), "paper_id", "entity_type", "entity_name")


def sort_by_relevance(df: DataFrame, *tie: str) -> DataFrame:
    """TOP5: relevance descending with an explicit tie key."""
    return df.orderBy(F.desc("relevance_score"), *tie)
