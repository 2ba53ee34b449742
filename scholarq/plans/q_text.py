"""Document-tree and sentiment queries (C5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarq.functions.text import WORD
from scholarq.operators import doctree as D
from scholarq.operators import search as S
from scholarq.operators import sentiment as SE
from scholarq.plans.fixtures import TEST_LEXICON
from scholarq.plans.oracle_views import with_views
from scholarq.plans.registry import query
from scholarq.plans.views import table, v_arxiv, v_docs
from scholarq.session import written

_MARK = '{"TYPE":"page-mark","VALUE":"[break]"}'
_STYLE = '"style":{"TYPE":"spacing","before":{"unit":"pt","size":6}}'
DEEP = 60  # levels around the lines that sit in a deep branch


def v_doc_tree(spark, d):
    """documents rendered as document trees: one paragraph per line; of five
    lines one sits in a table cell, one below ``DEEP`` nested groups; each
    plain paragraph is followed by a mark whose string VALUE must not be
    extracted.  Keys come in different orders."""
    docs = table(spark, d, "documents")
    leaf = lambda l: F.to_json(F.struct(F.lit("text").alias("TYPE"), l.alias("VALUE")))
    para = lambda l: F.concat(F.lit("{" + _STYLE + ',"VALUE":['), leaf(l), F.lit('],"TYPE":"paragraph"}'))  # noqa
    cell = lambda l: F.concat(F.lit('{"TYPE":"table","VALUE":[{"TYPE":"table-row","VALUE":[{"TYPE":"table-cell",'  # noqa
                                    '"VALUE":['), para(l), F.lit("]}]}]}"))
    deep = lambda l: F.concat(F.lit('{"TYPE":"group","VALUE":[' * DEEP), para(l), F.lit("]}" * DEEP))  # noqa
    items = F.transform(F.split(F.col("text"), "\n"),
                        lambda l, i: F.when(i % 5 == 1, cell(l)).when(i % 5 == 3, deep(l))
                        .otherwise(F.concat(para(l), F.lit("," + _MARK))))
    tree = F.concat(F.lit('{"TYPE":"document","VALUE":[{"TYPE":"body","VALUE":['), F.array_join(items, ","),
                    F.lit("]}]}"))
    return docs.select(F.col("doc_id").alias("paper_id"), tree.alias("tree"))


@query("doc_text_extract", """
    SELECT doc_id AS paper_id, CAST(i - 1 AS BIGINT) AS pos, t AS text FROM (
      SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""", "SRC4 DOC1")
def doc_text_extract(spark, d):
    return D.extract_texts(v_doc_tree(spark, d), "paper_id", "tree").withColumn("pos", F.col("pos").cast("long"))


@query("doc_fulltext", "SELECT doc_id AS paper_id, replace(text, chr(10), ' ') AS text FROM documents", "AGG12")
def doc_fulltext(spark, d):
    return D.full_text(v_doc_tree(spark, d), "paper_id", "tree", " ")


@query("doc_fulltext_newline", "SELECT doc_id AS paper_id, text FROM documents", "DOC3")
def doc_fulltext_newline(spark, d):
    return D.full_text(v_doc_tree(spark, d), "paper_id", "tree", "\n")


@query("doc_odd_escapes", "SELECT doc_id AS paper_id, doc_id || chr(65533) || 'x' || chr(128512) AS text FROM documents",
       "DOC1 AGG12 (escapes of lone surrogates)")
def doc_odd_escapes(spark, d):
    node = F.concat(F.lit('{"TYPE":"text","VALUE":"'), F.col("doc_id").cast("string"), F.lit('\\ud800x\\ud83d\\ude00"}'))
    return D.full_text(table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), node.alias("tree")), "paper_id", "tree")


@query("doc_toplevel", "SELECT doc_id AS paper_id, '' AS text FROM documents", "DOC2 (top-level list only)")
def doc_toplevel(spark, d):
    return D.top_level_texts(v_doc_tree(spark, d), "paper_id", "tree")


# ---------------------------------------------------------------- oracle SQL

def _lit_list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]::VARCHAR[]"


def _lex_map():
    ks = sorted(TEST_LEXICON.valences)
    return ("MAP {" + ", ".join(f"'{k}': {float(TEST_LEXICON.valences[k])!r}::DOUBLE" for k in ks) + "}")


def _scores_sql(src: str, id_cols: str, text: str) -> str:
    """DuckDB form of ``sentiment.score_columns`` over ``src`` (a FROM item)."""
    lex, neg, boost, damp = _lex_map(), *(_lit_list(x) for x in (
        TEST_LEXICON.negators, TEST_LEXICON.boosters, TEST_LEXICON.dampeners))
    base = f"COALESCE(({lex})[low[i]], 0.0)"
    steps = " + ".join(
        f"CASE WHEN i > {k} AND list_contains({boost}, low[i - {k}]) THEN {c * SE.BOOSTER_INCREMENT!r}::DOUBLE "
        f"WHEN i > {k} AND list_contains({damp}, low[i - {k}]) THEN {-c * SE.BOOSTER_INCREMENT!r}::DOUBLE ELSE 0.0 END"
        for k, c in enumerate(SE.DISTANCE_SCALARS, 1))
    vals = f"""list_transform(range(1, len(low) + 1), lambda i: CASE WHEN {base} = 0 THEN 0.0::DOUBLE ELSE
                 ({base} + sign({base}) * (CASE WHEN mixed AND toks[i] = upper(toks[i]) AND toks[i] <> lower(toks[i])
                                            THEN {SE.CAPITALS_INCREMENT} ELSE 0.0 END + 0.0 + {steps}))
                 * CASE WHEN list_has_any(low[greatest(i - 3, 1):i - 1], {neg}) THEN {SE.NEGATION_SCALAR}
                        ELSE 1.0 END END)"""
    return f"""SELECT {id_cols}, round(CASE WHEN s = 0 THEN 0.0
                            ELSE greatest(least(s / sqrt(s * s + {SE.NORMALISATION_ALPHA}), 1.0), -1.0) END, 4)
                      AS polarity,
                      (CASE WHEN tot > 0 THEN round(abs(ps / tot), 3) ELSE 0.0 END
                       + CASE WHEN tot > 0 THEN round(abs(ns / tot), 3) ELSE 0.0 END) / 2 AS subjectivity
               FROM (SELECT *, ps + abs(ns) + neu AS tot FROM (
                 SELECT * REPLACE (s + sign(s) * bangs AS s, ps + CASE WHEN ps > abs(ns) THEN bangs ELSE 0.0 END AS ps,
                                   ns - CASE WHEN ps < abs(ns) THEN bangs ELSE 0.0 END AS ns) FROM (
                 SELECT *, COALESCE(list_sum(v), 0.0) AS s,
                        COALESCE(list_sum(list_transform(v, lambda x: CASE WHEN x > 0 THEN x + 1 ELSE 0.0 END)), 0.0) AS ps,
                        COALESCE(list_sum(list_transform(v, lambda x: CASE WHEN x < 0 THEN x - 1 ELSE 0.0 END)), 0.0) AS ns,
                        CAST(len(list_filter(v, lambda x: x = 0)) AS DOUBLE) AS neu
                 FROM (SELECT *, {vals} AS v FROM (
                   SELECT *, list_transform(toks, lambda t: lower(t)) AS low,
                          len(list_filter(toks, lambda t: t <> upper(t))) > 0 AS mixed FROM (
                   SELECT *, regexp_extract_all({text}, '{WORD}') AS toks,
                          least({SE.MOST_EXCLAMATIONS}, length({text}) - length(replace({text}, '!', '')))
                          * {SE.EXCLAMATION_INCREMENT} AS bangs FROM {src}))))))"""


def _label_sql(p):
    return (f"CASE WHEN {p} > {SE.POSITIVE_ABOVE} THEN 'Positive' WHEN {p} < {SE.NEGATIVE_BELOW} "
            "THEN 'Negative' ELSE 'Neutral' END")


_SENT_SQL = """(SELECT * FROM (
      SELECT doc_id, CAST(i - 1 AS BIGINT) AS sent_idx, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS sentence
      FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (
              SELECT doc_id, string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l
              FROM documents)))
    WHERE sentence <> '')"""


@query("sentence_split", f"SELECT doc_id, sent_idx, sentence FROM {_SENT_SQL.format(text='text')}", "SEN1")
def sentence_split(spark, d):
    return SE.split_sentences(v_docs(spark, d), "doc_id", "text").withColumn("sent_idx", F.col("sent_idx").cast("long"))


@query("doc_sentiment", f"""SELECT doc_id, polarity, subjectivity, {_label_sql('polarity')} AS label
    FROM ({_scores_sql('documents', 'doc_id', 'COALESCE(text, \'\')')})""", "SEN2 SEN3 SEN4 SEN6")
def doc_sentiment(spark, d):
    return SE.document_sentiment(v_docs(spark, d), "doc_id", "text", TEST_LEXICON)


@query("sentence_sentiment", f"""SELECT doc_id, sent_idx, sentence, polarity, subjectivity
    FROM ({_scores_sql(_SENT_SQL.format(text='text'), 'doc_id, sent_idx, sentence', 'sentence')})""",
       "SEN1 SEN2 SEN3 SEN5")
def sentence_sentiment(spark, d):
    return SE.sentence_sentiment(v_docs(spark, d), "doc_id", "text", TEST_LEXICON).withColumn(
        "sent_idx", F.col("sent_idx").cast("long"))


@query("sentiment_labels", f"""SELECT {_label_sql('polarity')} AS label, COUNT(*) AS n
    FROM ({_scores_sql('documents', 'doc_id', 'COALESCE(text, \'\')')}) GROUP BY 1""", "SEN6")
def sentiment_labels(spark, d):
    return (SE.document_sentiment(v_docs(spark, d), "doc_id", "text", TEST_LEXICON)
            .groupBy("label").agg(F.count(F.lit(1)).alias("n")))


@query("result_sentiment", with_views(f"""
    SELECT arxiv_id, CASE WHEN has THEN {_label_sql('polarity')} ELSE 'N/A' END AS sentiment_label,
           CASE WHEN has THEN round(CAST(polarity AS DECIMAL(9, 4)), 2)::DOUBLE END AS sentiment_score
    FROM ({_scores_sql('''(SELECT arxiv_id, abstract IS NOT NULL AND abstract <> '' AS has,
                                  COALESCE(abstract, '') AS abstract FROM v_arxiv
                           WHERE instr(lower(concat_ws(' ', title, abstract, array_to_string(authors, ' '),
                                                       categories)), 'widget') > 0)''',
                       'arxiv_id, has', 'abstract')})""", "v_arxiv"), "SEN7 FLT8")
def result_sentiment(spark, d):
    res = S.search(v_arxiv(spark, d), "widget", "keyword")
    return SE.attach_sentiment(res, "abstract", TEST_LEXICON, key_cols=["arxiv_id"]).select(
        "arxiv_id", "sentiment_label", "sentiment_score")


_ONE_PAPER = 7


@query("paper_sentiment", f"""
    SELECT paper_id, CAST(NULL AS BIGINT) AS sent_idx, polarity, subjectivity
    FROM ({_scores_sql(f"(SELECT doc_id AS paper_id, replace(text, chr(10), ' ') AS t FROM documents WHERE doc_id = {_ONE_PAPER})",
                       'paper_id', 't')})
    UNION ALL
    SELECT doc_id AS paper_id, sent_idx, polarity, subjectivity
    FROM ({_scores_sql('(SELECT * FROM ' + _SENT_SQL.format(text="replace(text, chr(10), ' ')") + f' WHERE doc_id = {_ONE_PAPER})',
                       'doc_id, sent_idx', 'sentence')})""", "SEN8 (whole text and sentences of one paper's tree)")
def paper_sentiment(spark, d):
    tree = S.point_lookup(v_doc_tree(spark, d), "paper_id", _ONE_PAPER)
    overall, sents = SE.paper_sentiment(D.full_text(tree, "paper_id", "tree", " "), _ONE_PAPER, TEST_LEXICON)
    return (overall.select("paper_id", F.lit(None).cast("long").alias("sent_idx"), "polarity", "subjectivity")
            .unionByName(sents.select("paper_id", F.col("sent_idx").cast("long").alias("sent_idx"), "polarity", "subjectivity")))


@query("tree_sentiment", f"""
    SELECT o.paper_id, o.polarity, o.subjectivity, {_label_sql('o.polarity')} AS label,
           COALESCE(c.n_sentences, 0) AS n_sentences
    FROM ({_scores_sql("(SELECT doc_id AS paper_id, replace(text, chr(10), ' ') AS t FROM documents)",
                       'paper_id', 't')}) o
    LEFT JOIN (SELECT doc_id AS paper_id, COUNT(*) AS n_sentences
               FROM {_SENT_SQL.format(text="replace(text, chr(10), ' ')")} GROUP BY doc_id) c
      ON c.paper_id = o.paper_id""", "SEN8 DOC1 AGG12 (whole-text and sentence analysis of every paper tree)")
def tree_sentiment(spark, d):
    texts, _ = written(D.full_text(v_doc_tree(spark, d), "paper_id", "tree", " "), "texts")  # both analyses read them
    overall = SE.document_sentiment(texts, "paper_id", "text", TEST_LEXICON)
    n = (SE.split_sentences(texts, "paper_id", "text").groupBy("paper_id")
         .agg(F.count(F.lit(1)).alias("n_sentences")))
    return (overall.join(n, "paper_id", "left")
            .select("paper_id", "polarity", "subjectivity", "label",
                    F.coalesce(F.col("n_sentences"), F.lit(0)).alias("n_sentences")))
