"""DuckDB SQL for the stand-in views (mirrors ``scholarq.plans.views``).

Each entry is a CTE body; ``with_views(sql, *names)`` prepends the CTEs a
query needs (dependencies first).
"""

from __future__ import annotations

VIEW_SQL: dict[str, str] = {
    "v_papers": """
        SELECT o_orderkey AS paper_id,
               'paper-' || CAST(o_orderkey AS VARCHAR) AS paper_name,
               o_orderdate AS published,
               o_orderstatus AS status,
               'Papers/paper-' || CAST(o_orderkey AS VARCHAR) || '.pdf' AS paper_pdf,
               'Docs/paper-' || CAST(o_orderkey AS VARCHAR) || '.pdf.docx' AS paper_docx,
               'JSON/paper-' || CAST(o_orderkey AS VARCHAR) || '.pdf.json' AS paper_json,
               'Ents/paper-' || CAST(o_orderkey AS VARCHAR) || '.pdf.json' AS paper_entities
        FROM orders""",
    "v_mentions_raw": """
        SELECT l.l_orderkey AS paper_id, l.l_linenumber AS mention_no,
               CASE WHEN p.p_size <= 10 THEN split_part(p.p_name, ' ', 2) ELSE p.p_name END AS entity_name,
               CASE p.p_type WHEN 'STANDARD' THEN 'PERSON' WHEN 'PROMO' THEN 'ORG'
                             WHEN 'ECONOMY' THEN 'WORK_OF_ART' ELSE p.p_type END AS entity_type
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    "v_mentions": """
        SELECT paper_id, entity_name, entity_type, COUNT(*) AS count
        FROM v_mentions_raw GROUP BY paper_id, entity_name, entity_type""",
    "v_rows": """
        SELECT p.paper_id, p.paper_name, p.paper_pdf, p.paper_docx, p.paper_json, p.paper_entities,
               m.entity_name, m.entity_type, m.count
        FROM v_mentions m JOIN v_papers p ON p.paper_id = m.paper_id""",
    "v_arxiv": """
        SELECT 'ax' || CAST(o.o_orderkey AS VARCHAR) AS arxiv_id,
               o.o_orderkey AS paper_id,
               'Study of ' || COALESCE(g.title_words, 'nothing') AS title,
               d.text AS abstract,
               COALESCE(g.authors, CAST([] AS VARCHAR[])) AS authors,
               g.categories,
               g.authors_parsed,
               g.versions,
               CASE WHEN o.o_orderpriority = '5-LOW' AND o.o_orderstatus = 'F' THEN ''
                    WHEN o.o_orderpriority = '5-LOW' AND o.o_orderstatus = 'P'
                         THEN CAST(year(o.o_orderdate) AS VARCHAR) || '-13-05'
                    WHEN o.o_orderpriority = '4-NOT SPECIFIED' AND o.o_orderstatus = 'P'
                         THEN strftime(o.o_orderdate, '%Y-%-m-%-d')
                    WHEN o.o_orderpriority = '4-NOT SPECIFIED' AND o.o_orderstatus = 'F' THEN NULL
                    ELSE strftime(o.o_orderdate, '%Y-%m-%d') END AS update_date,
               CASE WHEN o.o_orderpriority = '1-URGENT' THEN '10.1000/' || CAST(o.o_orderkey AS VARCHAR)
                    WHEN o.o_orderpriority = '2-HIGH' THEN '' END AS doi,
               CASE WHEN o.o_orderstatus = 'F' THEN 'CC-BY-4.0' WHEN o.o_orderstatus = 'O' THEN '' END AS license,
               CASE WHEN o.o_orderpriority = '3-MEDIUM'
                    THEN 'J. Synth. ' || CAST(year(o.o_orderdate) AS VARCHAR) END AS journal_ref,
               o.o_orderdate AS published,
               COALESCE(g.updated, o.o_orderdate) AS updated
        FROM orders o
        LEFT JOIN (
            SELECT l.l_orderkey,
                   array_to_string(list_sort(list_distinct(list(p.p_type))), ' ') AS categories,
                   list_sort(list_distinct(list(s.s_name))) AS authors,
                   array_to_string(list_sort(list_distinct(list(p.p_name))), ' ') AS title_words,
                   list(CASE WHEN l.l_returnflag = 'R' THEN [s.s_name]
                             ELSE [s.s_name, CAST(s.s_nationkey AS VARCHAR)] END
                        ORDER BY l.l_linenumber) AS authors_parsed,
                   list({'version': 'v' || CAST(l.l_linenumber AS VARCHAR),
                         'created': strftime(l.l_shipdate, '%Y-%m-%d')} ORDER BY l.l_linenumber) AS versions,
                   max(l.l_shipdate) AS updated
            FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
                            JOIN supplier s ON l.l_suppkey = s.s_suppkey
            GROUP BY l.l_orderkey) g ON g.l_orderkey = o.o_orderkey
        LEFT JOIN documents d ON d.doc_id = o.o_orderkey""",
}

DEPENDS = {
    "v_mentions": ["v_mentions_raw"],
    "v_rows": ["v_mentions", "v_papers"],
}


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in DEPENDS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs for ``names`` (and their dependencies),
    then any ``extra`` CTEs in the given order."""
    ctes = [f"{n} AS ({VIEW_SQL[n]})" for n in _closure(names)]
    ctes += [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    if not ctes:
        return sql
    return "WITH " + ",\n".join(ctes) + "\n" + sql
