"""The compact forms of self-joins hold all pairs of all chunks."""

from paperloom.plans import pipeline, search
from tests.compare import connect

FOLDER = "/root/testdata/sf0.001"


def _members(spark, query):
    con = connect(FOLDER)
    con.register("members", query(spark, FOLDER).toPandas())
    return con


def _all(con, name):
    """The query's own SQL, without its choice of sources."""
    sql = search.SQL[name]
    assert "a.chunk_key % 100 = 0" in sql
    return sql.replace("a.chunk_key % 100 = 0", "true")


def test_entity_members_hold_all_edges(spark):
    con = _members(spark, search.entity_members)
    made = "SELECT a.chunk_key AS src, b.chunk_key AS dst, round(sum(CASE WHEN a.paper <> b.paper THEN 1.5 ELSE 0.8 END), 6) AS weight, count(*) AS n_shared, any_value(a.paper <> b.paper) AS cross_paper FROM members a JOIN members b ON a.entity = b.entity AND a.chunk_key <> b.chunk_key GROUP BY 1, 2"
    got, known = set(con.execute(made).fetchall()), set(con.execute(_all(con, "entity_edges")).fetchall())
    assert got == known and any(a % 100 and b % 100 for a, b, *_ in got)


def test_consensus_members_hold_all_pairs(spark):
    con = _members(spark, search.consensus_members)
    made = "SELECT DISTINCT a.chunk_key, b.chunk_key, CASE WHEN a.direction = b.direction THEN 'consensus' ELSE 'contradiction' END FROM members a JOIN members b ON a.entity = b.entity AND a.paper <> b.paper"
    got, known = set(con.execute(made).fetchall()), set(con.execute(_all(con, "consensus_pairs")).fetchall())
    assert got == known and any(a % 100 and b % 100 for a, b, _ in got)


def test_cross_paper_members_hold_all_paper_pairs(spark):
    con = _members(spark, pipeline.cross_paper_members)
    con.execute("CREATE TABLE c AS SELECT DISTINCT chunk_key, paper_id, lower(e) AS entity FROM (SELECT chunk_key, paper_id, unnest(entities) AS e FROM chunks) WHERE length(e) > 2")
    papers = lambda t: set(con.execute(f"SELECT DISTINCT a.entity, a.paper_id, b.paper_id FROM {t} a JOIN {t} b ON a.entity = b.entity AND a.paper_id < b.paper_id").fetchall())
    known = papers("c")
    assert papers("members") == known and len(known) > len(pipeline.cross_paper_pairs(spark, FOLDER).collect())
    n, own = con.execute("SELECT count(*), count(DISTINCT (entity, paper_id)) FROM members JOIN c USING (entity, paper_id, chunk_key)").fetchone()
    assert n == own == con.execute("SELECT count(*) FROM members").fetchone()[0]


def test_dedup_and_compression_take_the_graph_walk(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(search.L, "candidates", lambda *a, graph=True, **k: asked.append(graph) or spark.range(0))
    monkeypatch.setattr(search.L, "retrieved", lambda *a, graph=True, **k: asked.append(graph) or spark.range(0))
    for query in (search.dedup_greedy, search.compress_context):
        try:
            query(spark, FOLDER)
        except Exception:  # only the call counts
            pass
    assert asked == [True, True]
