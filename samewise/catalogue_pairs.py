"""Queries over scored pairs, labels and units, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from samewise.operators import loading as N
from samewise.operators import listing as I
from samewise.catalogue import COMPARISONS, MODEL, PAIRS, RULES, SCORED, _pairs, _scored, _suppliers, query, table
from samewise.functions import similarity as S
from samewise.operators import blocking as B
from samewise.operators import decisions as D
from samewise.operators import overlays as O
from samewise.operators import scoring as W

UNITS = "un AS (SELECT s_suppkey::VARCHAR AS unit_id, CASE WHEN s_nationkey % 2 = 0 THEN 'person' ELSE 'organisation' END AS track, CASE WHEN s_suppkey % 3 <> 0 THEN 'N' || s_nationkey::VARCHAR END AS existing_id, CASE WHEN s_suppkey % 2 = 0 THEN 'H-' || s_nationkey::VARCHAR END AS held_group_id, s_acctbal AS amount FROM supplier)"


def _units(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, d, "supplier").select(
        k.cast("string").alias("unit_id"),
        F.when(n % 2 == 0, "person").otherwise("organisation").alias("track"),
        F.when(k % 3 != 0, F.concat(F.lit("N"), n.cast("string"))).alias("existing_id"),
        F.when(k % 2 == 0, F.concat(F.lit("H-"), n.cast("string"))).alias("held_group_id"),
        F.col("s_acctbal").alias("amount"),
    )


def _in_context(spark, d, columns=("track", "existing_id", "held_group_id", "amount")):
    return O.of_units(_scored(spark, d), _units(spark, d), columns)


CONTEXT = f"{SCORED}, {UNITS}, cx AS (SELECT sc.*, a.track AS track_l, b.track AS track_r, a.existing_id AS ex_l, b.existing_id AS ex_r, a.held_group_id AS h_l, b.held_group_id AS h_r, a.amount AS amount_l, b.amount AS amount_r FROM sc JOIN un a ON a.unit_id = id_l JOIN un b ON b.unit_id = id_r)"


@query("v_track_line", f"WITH {CONTEXT} SELECT id_l, id_r, CASE WHEN match_probability >= CASE WHEN track_l = 'person' THEN 0.3 ELSE 0.6 END THEN 'accept' WHEN match_probability >= 0.1 THEN 'review' ELSE 'reject' END AS bucket FROM cx")
def v_track_line(spark, d):
    return _in_context(spark, d, ["track"]).select("id_l", "id_r", O.track_bucket(F.col("match_probability"), F.col("track_l"), 0.1, 0.6, {"person": 0.3}).alias("bucket"))


@query(
    "v_model_bucket",
    f"WITH {SCORED}, gm AS (SELECT *, CASE WHEN id_l::BIGINT % 2 = 0 THEN 1 - match_probability END AS model FROM sc) SELECT id_l, id_r, CASE WHEN coalesce(model, match_probability) >= 0.5 THEN 'accept' WHEN coalesce(model, match_probability) >= 0.1 THEN 'review' ELSE 'reject' END AS bucket, CASE WHEN model IS NULL THEN 'score' ELSE 'model' END AS decided_by FROM gm",
)
def v_model_bucket(spark, d):
    p = F.col("match_probability")
    rows = _scored(spark, d).withColumns({"bucket": D.bucket(p, 0.1, 0.5), "model": F.when(F.col("id_l").cast("long") % 2 == 0, 1 - p)})
    return O.model_bucket(rows, "model", 0.1, 0.5).select("id_l", "id_r", "bucket", "decided_by")


@query("v_similarity_veto", f"WITH {PAIRS} SELECT id_l, id_r, jaro_winkler_similarity(upper(ml), upper(mr)) < 0.99 AS hit FROM p")
def v_similarity_veto(spark, d):
    return _pairs(spark, d).select("id_l", "id_r", S.similarity_lt(F.col("name_l"), F.col("name_r"), 0.99).alias("hit"))


@query("v_veto_reason", f"WITH {PAIRS} SELECT id_l, id_r, 'nations ' || nl::VARCHAR || ' and ' || nr::VARCHAR AS reason FROM p WHERE nl <> nr")
def v_veto_reason(spark, d):
    n = [F.col(f"nation_{s}").cast("double") for s in "lr"]
    return _pairs(spark, d).where("nation_l <> nation_r").select("id_l", "id_r", O.veto_reason("nations {left} and {right}", *n).alias("reason"))


@query(
    "v_veto_report",
    f"""WITH {PAIRS}, b AS (SELECT id_l || '|' || id_r AS pair, nl, nr, bl, br, abs(bl - br) <= 400 AS acc FROM p), h AS (SELECT 'nation' AS veto_id, pair, acc, nl <> nr AS hit FROM b UNION ALL SELECT 'gap', pair, acc, abs(bl - br) > 200 FROM b),
x AS (SELECT veto_id, string_agg(pair, ' ' ORDER BY pair) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY veto_id ORDER BY pair) AS r FROM h WHERE hit) WHERE r <= 3 GROUP BY veto_id)
SELECT veto_id, count(*) FILTER (hit) AS hits, count(*) FILTER (hit AND acc) AS would_accept, coalesce(min(examples), '') AS examples FROM h LEFT JOIN x USING (veto_id) GROUP BY veto_id""",
)
def v_veto_report(spark, d):
    c = F.col
    rows = _pairs(spark, d).withColumn("bucket", F.when(F.abs(c("balance_l") - c("balance_r")) <= 400, "accept").otherwise("review"))
    return O.veto_report(rows, [("nation", D.veto("differs", c("nation_l"), c("nation_r"))), ("gap", D.veto("abs_diff_gt", c("balance_l"), c("balance_r"), 200))])


@query(
    "v_import_overlay",
    f"""WITH {CONTEXT}, b AS (SELECT *, CASE WHEN abs(amount_l - amount_r) > 200 THEN 'reject' WHEN match_probability >= 0.5 THEN 'accept' WHEN match_probability >= 0.1 THEN 'review' ELSE 'reject' END AS bk, abs(amount_l - amount_r) > 200 AS vetoed FROM cx)
SELECT id_l, id_r, CASE WHEN coalesce(ex_l = ex_r, false) THEN 'accept' ELSE bk END AS bucket, CASE WHEN coalesce(ex_l = ex_r, false) THEN 'import' WHEN vetoed THEN 'veto' ELSE 'score' END AS decided_by,
 coalesce(ex_l <> ex_r, false) AS import_disagrees, vetoed AND coalesce(ex_l = ex_r, false) AS veto_conflicts_import FROM b""",
)
def v_import_overlay(spark, d):
    rows = _in_context(spark, d, ["existing_id", "amount"]).withColumn("bucket", D.bucket(F.col("match_probability"), 0.1, 0.5))
    vetoed = D.apply_vetoes(rows, [("gap", D.veto("abs_diff_gt", F.col("amount_l"), F.col("amount_r"), 200), "reject")])
    return O.import_overlay(vetoed).select("id_l", "id_r", "bucket", "decided_by", "import_disagrees", "veto_conflicts_import")


@query("v_held_tag", f"WITH {CONTEXT} SELECT id_l, id_r, CASE WHEN h_l = h_r THEN h_l END AS held_group_id FROM cx")
def v_held_tag(spark, d):
    return O.held_tag(_in_context(spark, d, ["held_group_id"])).select("id_l", "id_r", "held_group_id")


@query("v_priority_total", f"WITH {CONTEXT} SELECT id_l, id_r, round(coalesce(amount_l, 0) + coalesce(amount_r, 0), 4) AS priority FROM cx")
def v_priority_total(spark, d):
    return _in_context(spark, d, ["amount"]).select("id_l", "id_r", F.round(O.priority(F.col("amount_l"), F.col("amount_r")), 4).alias("priority"))


@query(
    "v_track_union",
    f"WITH {CONTEXT} SELECT id_l, id_r, track_l AS track, CASE WHEN track_l = 'person' THEN match_probability END AS person_score, CASE WHEN track_l = 'organisation' THEN match_probability END AS organisation_score FROM cx WHERE track_l = track_r",
)
def v_track_union(spark, d):
    rows = _in_context(spark, d, ["track"]).where("track_l = track_r")
    return I.union_tracks({t: rows.where(F.col("track_l") == t).select("id_l", "id_r", F.col("match_probability").alias(f"{t}_score")) for t in ("person", "organisation")})


@query("v_agreement", f"WITH {CONTEXT} SELECT id_l, id_r, CASE WHEN ex_l = ex_r THEN 'agrees' WHEN ex_l <> ex_r THEN 'disagrees' ELSE 'unknown' END AS agreement FROM cx")
def v_agreement(spark, d):
    return _in_context(spark, d, ["existing_id"]).select("id_l", "id_r", O.agreement(F.col("existing_id_l"), F.col("existing_id_r")).alias("agreement"))


# ------------------------------------------------------------ labels: order lines as labels between parts, parts in units by brand

LABELS = "lb AS (SELECT l_orderkey * 10 + l_linenumber AS label_id, l_partkey::VARCHAR AS record_a, (l_partkey + l_suppkey)::VARCHAR AS record_b, l_returnflag <> 'N' AS same FROM lineitem)"
UNIT_OF = "mb AS (SELECT p_partkey::VARCHAR AS record_id, min(p_partkey::VARCHAR) OVER (PARTITION BY p_brand, p_size) AS unit_id FROM part)"
MAPPED = f"{LABELS}, {UNIT_OF}, lu AS (SELECT label_id, least(a.unit_id, b.unit_id) AS id_l, greatest(a.unit_id, b.unit_id) AS id_r, same, a.unit_id = b.unit_id AS same_unit FROM lb JOIN mb a ON a.record_id = record_a JOIN mb b ON b.record_id = record_b)"


def _labels(spark, d):
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("label_id"),
        F.col("l_partkey").cast("string").alias("record_a"),
        (F.col("l_partkey") + F.col("l_suppkey")).cast("string").alias("record_b"),
        (F.col("l_returnflag") != "N").alias("same"),
    )


def _members(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("record_id"), "p_brand", "p_size")
    return p.join(p.groupBy("p_brand", "p_size").agg(F.min("record_id").alias("unit_id")), ["p_brand", "p_size"]).select("record_id", "unit_id")


@query("v_label_unit_pairs", f"WITH {MAPPED} SELECT * FROM lu")
def v_label_unit_pairs(spark, d):
    return O.label_unit_pairs(_labels(spark, d), _members(spark, d)).select("label_id", "id_l", "id_r", "same", "same_unit")


@query("v_label_outcomes", f"WITH {MAPPED} SELECT CASE WHEN NOT same_unit THEN 'applied' WHEN same THEN 'satisfied' ELSE 'contradiction' END AS outcome, count(*) AS n FROM lu GROUP BY ALL")
def v_label_outcomes(spark, d):
    return O.label_unit_pairs(_labels(spark, d), _members(spark, d)).groupBy(O.label_outcome(F.col("same"), F.col("same_unit")).alias("outcome")).agg(F.count("*").alias("n"))


@query("v_forced_pairs", f"WITH {SCORED} SELECT s_suppkey::VARCHAR AS id_l, (s_suppkey * 7)::VARCHAR AS id_r, NULL::DOUBLE AS match_probability, 'reject' AS bucket FROM supplier WHERE s_suppkey <> 0 AND NOT EXISTS (SELECT 1 FROM sc WHERE id_l = s_suppkey::VARCHAR AND id_r = (s_suppkey * 7)::VARCHAR)")
def v_forced_pairs(spark, d):
    labels = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id_l"), (F.col("s_suppkey") * 7).cast("string").alias("id_r"))
    return O.forced_pairs(_scored(spark, d), labels)


@query(
    "v_repoint",
    f"""WITH {SCORED}, mv AS (SELECT s_suppkey::VARCHAR AS old, (s_suppkey - s_suppkey % 4)::VARCHAR AS new FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey > 4),
q AS (SELECT coalesce(a.new, id_l) AS x, coalesce(b.new, id_r) AS y, match_probability, id_l::BIGINT % 2 = 0 AS rescored FROM sc LEFT JOIN mv a ON a.old = id_l LEFT JOIN mv b ON b.old = id_r)
SELECT least(x, y) AS id_l, greatest(x, y) AS id_r, max(match_probability) AS match_probability, bool_and(rescored) AS rescored FROM q WHERE x <> y GROUP BY 1, 2""",
)
def v_repoint(spark, d):
    k = F.col("s_suppkey")
    moved = table(spark, d, "supplier").where((k % 2 == 1) & (k > 4)).select(k.cast("string").alias("old"), (k - k % 4).cast("string").alias("new"))
    return O.repoint(_scored(spark, d).withColumn("rescored", F.col("id_l").cast("long") % 2 == 0), moved)


@query("h_label_log", f"WITH {LABELS} SELECT label_id, lead(label_id) OVER w AS superseded_by, lead(label_id) OVER w IS NULL AS active, bool_or(label_id % 5 = 0) OVER (PARTITION BY record_a, record_b ORDER BY label_id ROWS UNBOUNDED PRECEDING) AS held_out FROM lb WINDOW w AS (PARTITION BY record_a, record_b ORDER BY label_id)")
def h_label_log(spark, d):
    return O.label_log(_labels(spark, d).withColumn("held_out", F.col("label_id") % 5 == 0)).select("label_id", "superseded_by", "active", "held_out")


@query("h_test_set", f"WITH {LABELS} SELECT label_id, row_number() OVER (PARTITION BY same ORDER BY label_id DESC) <= least(100, (count(*) OVER (PARTITION BY same)) // 2) AS held_out FROM lb")
def h_test_set(spark, d):
    return O.test_set(_labels(spark, d), 200).select("label_id", "held_out")


@query("h_library_counts", f"WITH {LABELS} SELECT count(*) AS total, count(*) FILTER (same) AS n_true, count(*) FILTER (NOT same) AS n_false, count(DISTINCT record_a) AS records FROM lb")
def h_library_counts(spark, d):
    return I.library_counts(_labels(spark, d))


@query(
    "h_decision_labels",
    """WITH p AS (SELECT o_custkey AS scope, o_orderstatus AS part, o_orderkey::VARCHAR AS record_id FROM orders), h AS (SELECT scope, part, min(record_id) AS head FROM p GROUP BY ALL)
SELECT scope, head AS record_a, record_id AS record_b, true AS same FROM p JOIN h USING (scope, part) WHERE record_id <> head UNION ALL SELECT a.scope, a.head, b.head, false FROM h a JOIN h b ON a.scope = b.scope AND a.head < b.head""",
)
def h_decision_labels(spark, d):
    return O.decision_labels(table(spark, d, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderstatus").alias("part"), F.col("o_orderkey").alias("record_id")))


# ------------------------------------------------------------ units

@query("u_existing_ids", "SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ' | ' ORDER BY o_orderstatus) AS ids, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS existing_id FROM orders GROUP BY o_custkey")
def u_existing_ids(spark, d):
    return O.existing_ids(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("u_never_scored", "SELECT o_custkey AS unit_id, count(*) AS unit_size FROM orders GROUP BY 1 EXCEPT SELECT o_custkey, count(*) FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def u_never_scored(spark, d):
    o = table(spark, d, "orders")
    size = lambda x: x.groupBy(F.col("o_custkey").alias("unit_id")).agg(F.count("*").alias("unit_size"))
    return O.never_scored(size(o), size(o.where("o_orderstatus <> 'P'")))


@query("u_priority_sum", "SELECT o_custkey, round(sum(o_totalprice::DECIMAL(38, 4))::DOUBLE, 2) AS priority FROM orders GROUP BY o_custkey")
def u_priority_sum(spark, d):
    return N.unit_sum(table(spark, d, "orders"), "o_custkey", "o_totalprice")


@query("u_unit_counts", f"WITH {UNITS} SELECT coalesce(track, 'all') AS track, count(*) AS n FROM un GROUP BY ROLLUP (track)")
def u_unit_counts(spark, d):
    return I.by_kind(_units(spark, d), "track", total="all")


@query("r_usefulness_weighed", f"WITH {CONTEXT}, t AS (SELECT *, amount_l + amount_r AS total, 1 - match_probability AS model FROM cx), m AS (SELECT max(total) AS top FROM t) SELECT id_l, id_r, round((0.5 * (1 - abs(2 * model - 1)) + 0.5 * abs(model - match_probability)) * (0.5 + 0.5 * least(greatest(CASE WHEN top > 0 THEN ln(1 + greatest(total, 0)) / ln(1 + top) ELSE 1 END, 0), 1)), 6) AS useful FROM t, m")
def r_usefulness_weighed(spark, d):
    p = F.col("match_probability")
    rows = _in_context(spark, d, ["amount"]).withColumn("total", O.priority(F.col("amount_l"), F.col("amount_r")))
    top = rows.agg(F.max("total").alias("top"))  # one row
    return rows.crossJoin(F.broadcast(top)).select("id_l", "id_r", F.round(O.usefulness(p, 1 - p, F.col("total"), F.col("top")), 6).alias("useful"))


@query("r_pairs_page", f"WITH {CONTEXT} SELECT id_l, id_r, match_probability FROM cx WHERE track_l = 'person' AND match_probability BETWEEN 0.001 AND 0.9 ORDER BY match_probability DESC NULLS LAST, id_l, id_r LIMIT 20 OFFSET 5")
def r_pairs_page(spark, d):
    p = F.col("match_probability")
    # the track is joined to units, not to their pairs, and goes before a pair is made
    tracks = _units(spark, d).select("unit_id", "track")
    units = _suppliers(spark, d).join(tracks, F.col("id").cast("string") == F.col("unit_id"))
    pairs = B.pairs(units, RULES, "id", ["balance", "nation", "band", "name", "track"], F.col("track_l") == "person")
    rows = W.score(W.gammas(pairs, COMPARISONS), COMPARISONS, MODEL).withColumn("match_probability", F.round("match_probability", 6))
    return I.page(rows, [F.desc_nulls_last("match_probability"), "id_l", "id_r"], 5, 20, p.between(0.001, 0.9), ["id_l", "id_r", "match_probability"], costly=True)


@query("d_bucket_histogram", f"WITH {SCORED} SELECT CASE WHEN match_probability >= 0.5 THEN 'accept' WHEN match_probability >= 0.1 THEN 'review' ELSE 'reject' END AS bucket, least(floor(match_probability * 50), 49)::BIGINT AS bin, count(*) AS n FROM sc GROUP BY ALL")
def d_bucket_histogram(spark, d):
    p = F.col("match_probability")
    return _scored(spark, d).groupBy(D.bucket(p, 0.1, 0.5).alias("bucket"), F.least(F.floor(p * 50), F.lit(49)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
