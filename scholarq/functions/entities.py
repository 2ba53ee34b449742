"""Entity-type vocabularies and column expressions (FLT1, FLT9, PRJ3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query word -> stored NER label (the search DSL's three types).
QUERY_TYPE_TO_LABEL = {
    "person": "PERSON",
    "organisation": "ORG",
    "work": "WORK_OF_ART",
}

# stored/requested type -> normalised result type.
RESULT_TYPE_NORMALISATION = {
    "person": "person",
    "PERSON": "person",
    "organisation": "organisation",
    "organization": "organisation",
    "ORG": "organisation",
    "work": "work",
}

LIMITS = ("one", "all")


def label_for(query_type: str) -> str:
    """FLT9: validate a query type word and return its stored label."""
    key = (query_type or "").lower()
    if key == "organization":
        key = "organisation"
    if key not in QUERY_TYPE_TO_LABEL:
        raise ValueError(f"entity type must be one of {sorted(QUERY_TYPE_TO_LABEL)}, got {query_type!r}")
    return QUERY_TYPE_TO_LABEL[key]


def check_limit(limit: str) -> str:
    if limit not in LIMITS:
        raise ValueError(f"limit must be 'one' or 'all', got {limit!r}")
    return limit


def normalised_type(type_col: Column, requested: str) -> Column:
    """PRJ3: mapping first, else lower-case, else the requested type."""
    m = F.create_map(*[F.lit(x) for kv in RESULT_TYPE_NORMALISATION.items() for x in kv])
    return F.coalesce(F.element_at(m, type_col), F.lower(type_col), F.lit(requested))


def normalised_type_sql(type_sql: str, requested: str) -> str:
    cases = " ".join(f"WHEN {type_sql} = '{k}' THEN '{v}'" for k, v in RESULT_TYPE_NORMALISATION.items())
    return f"COALESCE(CASE {cases} END, lower({type_sql}), '{requested}')"
