"""Entity-mention index and mention search (C1/C2).

AGG1, SNK8 (hash ids), JN1, JN2, FLT1-5, TOP1, AGG10, AGG16, TOP9.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarq.functions.entities import check_limit, label_for
from scholarq.operators.text_index import SubstringIndex

PAPER_COLS = ["paper_id", "paper_name", "paper_pdf", "paper_docx", "paper_json", "paper_entities"]


def entity_key_id(name: Column, etype: Column) -> Column:
    """Surrogate entity id = 64-bit hash of the natural key (type, name).

    Stable across re-ingests and computed where the row is, so building
    the link table needs no join back to ``entities``.  Collisions are
    checked by ``check_unique_ids``.
    """
    return F.xxhash64(etype, name)


def build_mention_index(raw_mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw (paper_id, entity_name, entity_type) occurrences -> (entities, papers_have_entities).

    AGG1: one count per (paper, entity); partial aggregation happens in the
    map tasks, so only distinct (paper, entity) keys cross the shuffle.
    """
    counts = (raw_mentions
              .groupBy("paper_id", "entity_name", "entity_type")
              .agg(F.count(F.lit(1)).alias("count")))
    phe = counts.select(entity_key_id(F.col("entity_name"), F.col("entity_type")).alias("entity_id"),
                        "paper_id", "count")
    # Entities come from the per-(paper, entity) counts, not the raw
    # mentions: the input is smaller and both outputs share one exchange.
    entities = (counts.select("entity_name", "entity_type").distinct()
                .select(entity_key_id(F.col("entity_name"), F.col("entity_type")).alias("entity_id"),
                        "entity_name", "entity_type"))
    return entities, phe


def check_unique_ids(entities: DataFrame) -> DataFrame:
    """Rows whose hash id is shared by two different keys (expected: none)."""
    return (entities.groupBy("entity_id")
            .agg(F.countDistinct("entity_name", "entity_type").alias("n_keys"))
            .filter(F.col("n_keys") > 1))


@dataclass(frozen=True)
class Clause:
    """One ``<type> <name>`` clause; ``etype`` None means any type."""
    etype: str | None
    name: str

    def predicate(self) -> Column:
        p = F.col("entity_name") == F.lit(self.name)
        if self.etype is not None:
            p = (F.col("entity_type") == F.lit(label_for(self.etype))) & p
        return p


def _combine(preds: list[Column], connectors: list[str]) -> Column:
    """Left-to-right clause list with SQL precedence (AND binds tighter)."""
    if len(connectors) != len(preds) - 1:
        raise ValueError("need one connector between consecutive clauses")
    groups: list[list[Column]] = [[preds[0]]]
    for op, p in zip(connectors, preds[1:]):
        op = op.lower()
        if op == "and":
            groups[-1].append(p)
        elif op == "or":
            groups.append([p])
        else:
            raise ValueError(f"connector must be 'and' or 'or', got {op!r}")
    out = None
    for g in groups:
        conj = g[0]
        for p in g[1:]:
            conj = conj & p
        out = conj if out is None else (out | conj)
    return out


def mention_rows(papers: DataFrame, phe: DataFrame, entities: DataFrame) -> DataFrame:
    """JN1: papers ⋈ papers_have_entities ⋈ entities, one row per (paper, entity)."""
    return (phe.join(entities, "entity_id")
            .join(papers.select(*PAPER_COLS), "paper_id")
            .select(*PAPER_COLS, "entity_id", "entity_name", "entity_type", "count"))


def mention_search(papers: DataFrame, phe: DataFrame, entities: DataFrame,
                   clauses: list[Clause], connectors: list[str] | None = None,
                   limit: str = "all", mode: str = "paper") -> DataFrame:
    """Papers that mention the given entities (FLT1-3, TOP1).

    mode="paper": a clause holds for a paper if any of its mentions
    matches it; the and/or expression is evaluated per paper and the
    matching mention rows of qualifying papers are returned.
    mode="row": the expression is evaluated on each joined row.
    """
    check_limit(limit)
    connectors = connectors or []
    if not clauses:
        out = papers.select(*PAPER_COLS)  # FLT4: no clause -> all papers
        return out.orderBy("paper_id").limit(1) if limit == "one" else out
    preds = [c.predicate() for c in clauses]
    expr = _combine(preds, connectors)
    # Entity-side filter first: it is the selective side; AQE turns the
    # joins into broadcasts once the filtered entities are seen to be small.
    any_pred = preds[0]
    for p in preds[1:]:
        any_pred = any_pred | p
    ents = entities.filter(any_pred)
    rows = mention_rows(papers, phe, ents)
    if mode == "row":
        out = rows.filter(expr)
    elif mode == "paper":
        # Per-paper clause flags over the (small) candidate rows; one
        # shuffle on paper_id.
        w = Window.partitionBy("paper_id")
        names = [f"_c{i}" for i in range(len(preds))]
        for n, p in zip(names, preds):
            rows = rows.withColumn(n, F.max(p.cast("int")).over(w) == 1)
        out = rows.filter(_combine([F.col(n) for n in names], connectors)).drop(*names)
    else:
        raise ValueError("mode must be 'paper' or 'row'")
    if limit == "one":
        out = out.orderBy("paper_id", "entity_name", "entity_type").limit(1)
    return out


def mention_like_papers(papers: DataFrame, phe: DataFrame, entities: DataFrame,
                        term: str, label: str = "ORG") -> DataFrame:
    """FLT5 + JN2: papers mentioning an entity of ``label`` whose name contains
    ``term`` (case-insensitive); one row per paper (semi join)."""
    esc = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    ents = entities.filter((F.col("entity_type") == F.lit(label))
                           & F.col("entity_name").ilike(f"%{esc}%"))
    hits = phe.join(ents, "entity_id", "left_semi")
    return papers.select(*PAPER_COLS).join(hits.select("paper_id"), "paper_id", "left_semi")


def like_papers_by_index(papers: DataFrame, phe: DataFrame, names: SubstringIndex, term: str, label: str = "ORG") -> DataFrame:
    """FLT5 + JN2 as ``mention_like_papers``, with the entities found through an index of their names."""
    ents = names.containing(term).filter(F.col("entity_type") == F.lit(label))
    hits = phe.join(ents, "entity_id", "left_semi")
    return papers.select(*PAPER_COLS).join(hits.select("paper_id"), "paper_id", "left_semi")


def entity_type_distribution(rows: DataFrame) -> DataFrame:
    """AGG10: count of result rows per entity type."""
    return rows.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


def distinct_entity_types(entities: DataFrame) -> DataFrame:
    """AGG16."""
    return entities.select("entity_type").distinct()


def sample_entities(entities: DataFrame, label: str, n: int = 5) -> DataFrame:
    """TOP9: n entities of one type (ordered by name for determinism)."""
    return (entities.filter(F.col("entity_type") == F.lit(label))
            .orderBy("entity_name").limit(n).select("entity_name", "entity_type"))
