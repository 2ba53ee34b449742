import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "relevance_score" in df.columns


def test_oracles_are_known_and_names_are_whole():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    from scholarq.plans.catalog import REGISTRY
    assert set(REGISTRY) <= set(sql)  # every query of the library itself has its oracle


@pytest.mark.parametrize("part", range(4))
def test_every_query_matches_its_oracle_on_the_smallest_tables(spark, part):
    from scholarq.plans.catalog import REGISTRY
    from tools.check_oracle import TABLES, digest
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    wrong = []
    for name in sorted(REGISTRY)[part::4]:
        got = REGISTRY[name].build(spark, SF)
        want = con.execute(REGISTRY[name].sql)
        if digest(got.columns, [tuple(r) for r in got.collect()])[0] != digest([c[0] for c in want.description], want.fetchall())[0]:
            wrong.append(name)
    assert not wrong


def test_clusters_are_returned_and_not_only_checked(spark):
    qs = E.queries()
    places, flags = qs["kmeans_member_places"](spark, SF), qs["kmeans_members"](spark, SF)
    assert places.columns == ["paper_id", "title", "cluster", "x", "y"]
    rows = places.collect()
    assert {r["paper_id"] for r in rows} == {r["paper_id"] for r in flags.collect()} and {r["cluster"] for r in rows} == {0, 1, 2}
    assert len({(r["x"], r["y"]) for r in rows}) > 3
    terms = qs["kmeans_term_weights"](spark, SF)
    assert terms.columns == ["cluster", "rank", "term", "weight"]
    for r in qs["kmeans_cluster_terms"](spark, SF).collect():
        own = sorted((t["rank"], t["weight"], t["term"]) for t in terms.collect() if t["cluster"] == r["cluster"])
        assert [x[0] for x in own] == list(range(1, r["n_terms"] + 1)) and len({x[2] for x in own}) == len(own)
        assert [x[1] for x in own] == sorted((x[1] for x in own), reverse=True)
