"""Explicit schemas (no inference at scale)."""

from pyspark.sql import types as T

PAPERS = T.StructType([
    T.StructField("paper_id", T.LongType(), False),
    T.StructField("paper_name", T.StringType(), False),
    T.StructField("paper_pdf", T.StringType(), False),
    T.StructField("paper_docx", T.StringType(), False),
    T.StructField("paper_json", T.StringType(), False),
    T.StructField("paper_entities", T.StringType(), False),
])

ENTITIES = T.StructType([
    T.StructField("entity_id", T.LongType(), False),
    T.StructField("entity_name", T.StringType(), False),
    T.StructField("entity_type", T.StringType(), False),
])

PAPERS_HAVE_ENTITIES = T.StructType([
    T.StructField("entity_id", T.LongType(), False),
    T.StructField("paper_id", T.LongType(), False),
    T.StructField("count", T.LongType(), False),
])

ARXIV_PAPERS = T.StructType([
    T.StructField("arxiv_id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("abstract", T.StringType(), True),
    T.StructField("authors", T.ArrayType(T.StringType()), True),
    T.StructField("categories", T.ArrayType(T.StringType()), True),
    T.StructField("published", T.TimestampType(), True),
    T.StructField("updated", T.TimestampType(), True),
    T.StructField("pdf_url", T.StringType(), True),
    T.StructField("relevance_score", T.DoubleType(), True),
    T.StructField("json_data", T.StringType(), True),
])

ENTITY_MENTION = T.StructType([
    T.StructField("text", T.StringType(), True),
    T.StructField("start_char", T.IntegerType(), True),
    T.StructField("end_char", T.IntegerType(), True),
    T.StructField("label", T.StringType(), True),
])

ENTS_FILE = T.StructType([
    T.StructField("entities", T.ArrayType(ENTITY_MENTION), True),
])

ENTS_RECORD = T.StructType([
    T.StructField("paper_pdf", T.StringType(), True),
    *ENTS_FILE.fields,
    T.StructField("_corrupt", T.StringType(), True),
])

SNAPSHOT_RECORD = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("authors", T.StringType(), True),
    T.StructField("abstract", T.StringType(), True),
    T.StructField("categories", T.StringType(), True),
    T.StructField("authors_parsed", T.ArrayType(T.ArrayType(T.StringType())), True),
    T.StructField("versions", T.ArrayType(T.StructType([
        T.StructField("version", T.StringType(), True),
        T.StructField("created", T.StringType(), True),
    ])), True),
    T.StructField("update_date", T.StringType(), True),
    T.StructField("doi", T.StringType(), True),
    T.StructField("license", T.StringType(), True),
    T.StructField("journal-ref", T.StringType(), True),
])
