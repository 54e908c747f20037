"""Queries of vetoes over lists, lines that change, figures against earlier ids, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from samewise.catalogue import _scored, query, table
from samewise.catalogue_pairs import CONTEXT, _in_context, _units
from samewise.catalogue_training import LINE_SQL, _graded, _low
from samewise.functions import text as X
from samewise.operators import clusters as G
from samewise.operators import decisions as D
from samewise.operators import entities as E
from samewise.operators import listing as I
from samewise.operators import overlays as O
from samewise.operators import training as T


@query("c_copy", "SELECT p_partkey, p_name AS name FROM part")
def c_copy(spark, d):
    return table(spark, d, "part").select("p_partkey", X.step("copy", F.col("p_name")).alias("name"))


@query("v_veto_missing", "SELECT p_partkey, nullif(p_size % 5, 0) IS DISTINCT FROM nullif(p_partkey % 5, 0) OR p_size % 5 = 0 AS hit FROM part")
def v_veto_missing(spark, d):
    l, r = F.expr("nullif(p_size % 5, 0)"), F.expr("nullif(p_partkey % 5, 0)")
    return table(spark, d, "part").select("p_partkey", D.veto("not_equal_or_missing", l, r).alias("hit"))


@query("v_veto_both_listed", "SELECT c_custkey, c_nationkey % 5 IN (1, 2, 3) AND c_custkey % 5 IN (1, 2, 3) AND c_nationkey % 5 <> c_custkey % 5 AS hit FROM customer")
def v_veto_both_listed(spark, d):
    l, r = (F.col(c) % 5 for c in ("c_nationkey", "c_custkey"))
    return table(spark, d, "customer").select("c_custkey", D.veto("both_in_and_differ", l, r, values=["1", "2", "3"]).alias("hit"))


@query("v_veto_no_overlap", "SELECT p_partkey, NOT (p_size % 3 = p_partkey % 3 OR p_size % 3 = 2) AS hit FROM part")
def v_veto_no_overlap(spark, d):
    l = F.concat_ws(" | ", F.lit("x"), (F.col("p_size") % 3).cast("string"))
    r = F.concat_ws(" | ", (F.col("p_partkey") % 3).cast("string"), F.lit("2"), F.lit("y"))
    return table(spark, d, "part").select("p_partkey", D.veto("no_overlap", l, r).alias("hit"))


@query(
    "v_rebucket",
    f"""WITH {CONTEXT}, b AS (SELECT *, CASE WHEN match_probability >= 0.4 THEN 'accept' WHEN match_probability >= 0.05 THEN 'review' ELSE 'reject' END AS b0, abs(amount_l - amount_r) > 200 AS far FROM cx),
v AS (SELECT *, CASE WHEN far AND b0 = 'accept' THEN 'review' ELSE b0 END AS b1, CASE WHEN far THEN 'gap' END AS veto_id FROM b)
SELECT id_l, id_r, CASE WHEN ex_l = ex_r THEN 'accept' ELSE b1 END AS bucket, CASE WHEN ex_l = ex_r THEN 'import' WHEN veto_id IS NOT NULL THEN 'veto' ELSE 'score' END AS decided_by, veto_id FROM v""",
)
def v_rebucket(spark, d):
    rows = _in_context(spark, d, ["existing_id", "amount"]).withColumns({"bucket": F.lit("accept"), "veto_id": F.lit("old"), "decided_by": F.lit("old")})
    gap = D.veto("abs_diff_gt", F.col("amount_l"), F.col("amount_r"), 200)
    return O.rebucket(rows, 0.05, 0.4, [("gap", gap, "review")], existing="existing_id").select("id_l", "id_r", "bucket", "decided_by", "veto_id")


@query("r_pairs_index", f"WITH {CONTEXT} SELECT id_l, id_r, match_probability, track_l, track_r, CASE WHEN ex_l = ex_r THEN 'agrees' WHEN ex_l <> ex_r THEN 'disagrees' ELSE 'unknown' END AS agreement FROM cx")
def r_pairs_index(spark, d):
    return I.pairs_index(_scored(spark, d), _units(spark, d), ["track"]).select("id_l", "id_r", "match_probability", "track_l", "track_r", "agreement")


MEMBERS = "m AS (SELECT o_orderkey AS record_id, o_custkey % 50 AS entity_id, CASE WHEN o_orderkey % 7 > 0 THEN 'E' || CASE WHEN o_custkey % 50 < 10 THEN o_custkey % 50 WHEN o_custkey % 50 < 20 THEN 100 + o_custkey % 5 WHEN o_custkey % 50 < 45 THEN o_orderkey % 200 END END AS existing_id FROM orders)"


def _members(spark, d):
    e, k = F.col("o_custkey") % 50, F.col("o_orderkey")
    earlier = F.when(e < 10, e).when(e < 20, 100 + F.col("o_custkey") % 5).when(e < 45, k % 200)
    return table(spark, d, "orders").select(k.alias("record_id"), e.alias("entity_id"), F.when(k % 7 > 0, F.concat(F.lit("E"), earlier.cast("string"))).alias("existing_id"))


VERDICTS = f"""{MEMBERS}, p AS (SELECT entity_id, existing_id, count(*) AS n FROM m GROUP BY ALL), w AS (SELECT existing_id, sum(n) AS whole FROM p WHERE existing_id IS NOT NULL GROUP BY 1),
vd AS (SELECT entity_id, sum(n)::BIGINT AS n_records, count(existing_id) AS n_earlier, CASE WHEN count(existing_id) = 0 THEN 'new' WHEN count(existing_id) > 1 THEN 'joined' WHEN bool_or(n <> whole) THEN 'divided' WHEN count(*) > count(existing_id) THEN 'grown' ELSE 'identical' END AS verdict FROM p LEFT JOIN w USING (existing_id) GROUP BY 1)"""


@query("e_against_earlier", f"WITH {VERDICTS} SELECT * FROM vd")
def e_against_earlier(spark, d):
    return E.against_earlier(_members(spark, d))


@query(
    "e_entity_figures",
    f"""WITH {VERDICTS}, k AS (SELECT * FROM m WHERE existing_id IS NOT NULL), t AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS true_pairs FROM (SELECT count(*) AS n FROM k GROUP BY entity_id, existing_id)), f AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS found_pairs FROM (SELECT count(*) AS n FROM k GROUP BY entity_id)), l AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS label_pairs FROM (SELECT count(*) AS n FROM k GROUP BY existing_id)),
c AS (SELECT count(*) AS entities, count(*) FILTER (verdict = 'identical') AS identical, count(*) FILTER (verdict = 'grown') AS grown, count(*) FILTER (verdict = 'divided') AS divided, count(*) FILTER (verdict = 'joined') AS joined, count(*) FILTER (verdict = 'new') AS "new" FROM vd)
SELECT *, round(true_pairs / found_pairs, 6) AS precision, round(true_pairs / label_pairs, 6) AS recall, CASE WHEN entities > "new" THEN round(identical / (entities - "new"), 6) END AS identical_share FROM t, f, l, c""",
)
def e_entity_figures(spark, d):
    return E.entity_figures(_members(spark, d))


@query("u_controller_profile", "SELECT l_suppkey AS unit_id, count(DISTINCT l_orderkey) AS n_companies FROM lineitem GROUP BY 1")
def u_controller_profile(spark, d):
    return G.controller_profile(table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "unit_id"), "unit_id", "l_orderkey")


@query("u_profile_columns", "SELECT o_custkey, max(o_orderdate)::DATE AS latest, round(sum(o_totalprice::DECIMAL(38, 4))::DOUBLE, 2) AS total FROM orders GROUP BY 1")
def u_profile_columns(spark, d):
    total = F.round(F.sum(F.col("o_totalprice").cast("decimal(28,4)")).cast("double"), 2)
    return G.unit_profile(table(spark, d, "orders"), "o_custkey", {"latest": F.to_date(F.max("o_orderdate")), "total": total}, ["latest", "total"])


@query("z_score_bands", "SELECT CASE WHEN l_quantity IS NULL THEN NULL WHEN l_quantity / 50 >= 0.8 THEN 4 WHEN l_quantity / 50 >= 0.6 THEN 3 WHEN l_quantity / 50 >= 0.4 THEN 2 WHEN l_quantity / 50 >= 0.2 THEN 1 ELSE 0 END AS band, count(*) AS n FROM lineitem GROUP BY 1")
def z_score_bands(spark, d):
    return table(spark, d, "lineitem").groupBy(I.band(F.col("l_quantity") / 50).alias("band")).agg(F.count("*").alias("n"))


@query(
    "z_conformal_lines",
    f"""WITH every AS (SELECT *, ('0x' || substr(md5(k::VARCHAR), 1, 8))::BIGINT % 2 AS half FROM (SELECT l_orderkey * 10 + l_linenumber AS k, round(l_quantity / 50, 2) AS s, l_quantity + (l_partkey * 7 % 20) > 35 AS y FROM lineitem)), rr AS (SELECT s, y FROM every WHERE half = 0), {LINE_SQL},
m0 AS (SELECT min(s) FILTER ({_low('ha', 'above')} >= 0.9) AS accept, max(s) FILTER (every > above AND {_low('((every-hits)-(above-ha))', 'nullif(every-above,0)')} >= 0.9) AS reject FROM k), m AS (SELECT accept, CASE WHEN accept IS NULL OR reject <= accept THEN reject END AS reject FROM m0),
g AS (SELECT accept, reject, count(*) FILTER (s >= accept) AS n_accept, count(*) FILTER (s >= accept AND NOT y) AS ea, count(*) FILTER (s < reject) AS n_reject, count(*) FILTER (s < reject AND y) AS er FROM every, m WHERE half = 1 GROUP BY accept, reject)
SELECT accept, reject, n_accept, CASE WHEN n_accept > 0 THEN round(ea / n_accept, 6) END AS accept_error, n_reject, CASE WHEN n_reject > 0 THEN round(er / n_reject, 6) END AS reject_error FROM g""",
)
def z_conformal_lines(spark, d):
    return T.conformal_lines(_graded(spark, d), "k", "s", "y", 0.9)
