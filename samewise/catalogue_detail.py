"""Queries of detail pages, edge-set evaluation and corroborated keys, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from samewise.operators import listing as I
from samewise.catalogue import EDGES, _edges, query, table
from samewise.operators import decisions as D
from samewise.operators import exact as M
from samewise.operators.graph import connected_components


@query(
    "m_corroborated_key",
    """WITH RECURSIVE r AS (SELECT c_custkey::VARCHAR AS record_id, c_mktsegment || c_nationkey AS k, (c_custkey % 3)::VARCHAR AS a, CASE WHEN c_acctbal > 0 THEN floor(c_acctbal / 2000)::BIGINT::VARCHAR END AS b FROM customer), g AS (SELECT k FROM r GROUP BY k HAVING count(*) > 1),
v AS (SELECT k, record_id, 0 AS c, a AS v FROM r WHERE k IN (FROM g) AND a <> '0' UNION ALL SELECT k, record_id, 1, b FROM r WHERE k IN (FROM g) AND b IS NOT NULL), e AS (SELECT DISTINCT l.record_id AS x, o.record_id AS y FROM v l JOIN v o USING (k, c, v) WHERE l.record_id <> o.record_id),
rc AS (SELECT x AS node, y AS other FROM e UNION SELECT rc.node, e.y FROM rc JOIN e ON rc.other = e.x) SELECT node AS record_id, 'X-' || least(min(other), node) AS group_id, 'merged' AS status, 'seg' AS key_ids, NULL::VARCHAR AS guard FROM rc GROUP BY node""",
)
def m_corroborated_key(spark, d):
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    r = table(spark, d, "customer").select(k.alias("record_id"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("k"), F.nullif((k % 3).cast("string"), F.lit("0")).alias("a"), F.when(bal > 0, F.floor(bal / 2000).cast("string")).alias("b"))
    return M.exact_groups(r, [M.MatchKey("seg", ["k"], require_any=["a", "b"])])


@query(
    "d_edge_evaluation",
    f"""WITH RECURSIVE {EDGES}, sets AS (SELECT 'all' AS edge_set, src, dst FROM ed UNION ALL SELECT 'near', src, dst FROM e0 WHERE gap <= 300), bw AS (SELECT edge_set, src AS a, dst AS b FROM sets UNION SELECT edge_set, dst, src FROM sets),
rc AS (SELECT edge_set, a AS node, b AS other FROM bw UNION SELECT r.edge_set, r.node, w.b FROM rc r JOIN bw w ON r.other = w.a AND r.edge_set = w.edge_set), cc AS (SELECT edge_set, node, least(min(other), node) AS component FROM rc GROUP BY edge_set, node),
m AS (SELECT x.edge_set, coalesce(component, s_suppkey) AS grp, s_suppkey % 4 AS label FROM supplier CROSS JOIN (VALUES ('all'), ('near')) x(edge_set) LEFT JOIN cc ON node = s_suppkey AND cc.edge_set = x.edge_set),
t AS (SELECT edge_set, sum(n * (n - 1) // 2)::BIGINT AS p FROM (SELECT edge_set, count(*) AS n FROM m GROUP BY edge_set, grp, label) GROUP BY 1), f AS (SELECT edge_set, sum(n * (n - 1) // 2)::BIGINT AS p, count(*) AS entities FROM (SELECT edge_set, count(*) AS n FROM m GROUP BY edge_set, grp) GROUP BY 1), r AS (SELECT edge_set, sum(n * (n - 1) // 2)::BIGINT AS p FROM (SELECT edge_set, count(*) AS n FROM m GROUP BY edge_set, label) GROUP BY 1)
SELECT edge_set, entities, t.p AS true_pairs, f.p AS found_pairs, r.p AS label_pairs, CASE WHEN f.p <> 0 THEN round(t.p / f.p, 6) END AS precision, CASE WHEN r.p <> 0 THEN round(t.p / r.p, 6) END AS recall FROM t JOIN f USING (edge_set) JOIN r USING (edge_set)""",
)
def d_edge_evaluation(spark, d):
    e, s = _edges(spark, d), table(spark, d, "supplier")
    out = None
    for name, edges in (("all", e), ("near", e.where("gap <= 300"))):
        cc = connected_components(edges).withColumnRenamed("node", "s_suppkey")
        m = s.join(cc, "s_suppkey", "left").select(F.coalesce("component", "s_suppkey").alias("grp"), (F.col("s_suppkey") % 4).alias("label"))
        figures = D.pair_figures(m, "grp", "label").crossJoin(m.agg(F.count_distinct("grp").alias("entities"))).withColumn("edge_set", F.lit(name))  # one row each
        out = figures if out is None else out.unionByName(figures)
    return out


@query("r_cluster_detail", "SELECT o_custkey AS unit_id, o_orderkey AS record_id, count(*) OVER (PARTITION BY o_custkey) > 5 AS truncated FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 5")
def r_cluster_detail(spark, d):
    o = table(spark, d, "orders").withColumnsRenamed({"o_custkey": "unit_id", "o_orderkey": "record_id"})
    return I.detail(o, "unit_id", [F.desc("o_orderdate"), "record_id"], 5).select("unit_id", "record_id", "truncated")


@query("r_representatives", "SELECT o_custkey AS unit_id, min(o_orderkey) AS representative, count(*) AS n_records, max(o_orderdate)::DATE AS latest FROM orders GROUP BY 1")
def r_representatives(spark, d):
    return I.representatives(table(spark, d, "orders").withColumnRenamed("o_custkey", "unit_id"), "unit_id", "o_orderkey", "o_orderdate")


@query("r_labels_by_decision", "SELECT coalesce(CASE WHEN l_linenumber > 2 THEN 'd' || l_orderkey END, 'label:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS decision, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_true FROM lineitem GROUP BY 1")
def r_labels_by_decision(spark, d):
    t = lambda c: F.col(c).cast("string")
    own = F.concat_ws("-", t("l_orderkey"), t("l_linenumber"), t("l_partkey"))
    decision = F.when(F.col("l_linenumber") > 2, F.concat(F.lit("d"), t("l_orderkey")))
    return I.by_decision(table(spark, d, "lineitem"), decision, own, F.col("l_returnflag") == "R")


@query("r_exact_groups_list", "SELECT c_nationkey AS group_id, count(*) AS n_records, count(DISTINCT c_mktsegment) AS n_labels, CASE WHEN count(DISTINCT c_mktsegment) > 4 THEN 'conflict' ELSE 'consistent' END AS agreement FROM customer GROUP BY 1 HAVING count(*) >= 2")
def r_exact_groups_list(spark, d):
    return I.group_list(table(spark, d, "customer").withColumnRenamed("c_nationkey", "group_id"), "group_id", "c_mktsegment", 4)
