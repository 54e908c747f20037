"""Queries over features and grading figures, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from samewise.catalogue import SCORES, _truths, query, table
from samewise.operators import features as X
from samewise.operators import training as T

PROFILE = """op AS (SELECT o_custkey, round(o_totalprice / 5000) * 500 AS v, year(o_orderdate) AS y, o_orderpriority AS p FROM orders), ct AS (SELECT o_custkey, v, count(*) AS k FROM op GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k DESC, v DESC) AS r FROM ct),
tp AS (SELECT o_custkey, max(v) FILTER (r = 1) AS modal_value, string_agg(v::BIGINT::VARCHAR, ' | ' ORDER BY r) AS top_values FROM rk WHERE r <= 5 GROUP BY 1),
pf AS (SELECT o_custkey, count(v) AS n, median(v) AS median_value, avg(CASE WHEN v > 0 AND v % 1000 = 0 THEN 1.0 ELSE 0.0 END) AS share_round, quantile_cont(log10(v + 1), [0.1, 0.25, 0.5, 0.75, 0.9]) FILTER (v > 0) AS quantiles FROM op GROUP BY 1),
un AS (SELECT *, count(*) OVER () AS every FROM pf JOIN tp USING (o_custkey) JOIN (SELECT o_custkey, min(y) AS first_year, max(y) AS last_year, list_sort(list_distinct(list(p))) AS parties FROM op GROUP BY 1) USING (o_custkey))"""


def _profiles(spark, d):
    o = table(spark, d, "orders").select("o_custkey", (F.round(F.col("o_totalprice") / 5000) * 500).alias("v"), F.year("o_orderdate").alias("y"), "o_orderpriority")
    own = o.groupBy("o_custkey").agg(F.min("y").alias("first_year"), F.max("y").alias("last_year"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), " | ").alias("parties"))
    return X.amount_profile(o, "o_custkey", "v").join(own, "o_custkey")


@query("l_top_amounts", f"WITH {PROFILE} SELECT o_custkey, n, median_value, modal_value, top_values, round(share_round, 6) AS share_round, round(quantiles[3], 6) AS q50 FROM pf JOIN tp USING (o_custkey)")
def l_top_amounts(spark, d):
    o = table(spark, d, "orders").select("o_custkey", (F.round(F.col("o_totalprice") / 5000) * 500).alias("v"))
    out = X.amount_profile(o, "o_custkey", "v")
    return out.select("o_custkey", "n", "median_value", "modal_value", F.regexp_replace("top_values", r",|\.00", "").alias("top_values"), F.round("share_round", 6).alias("share_round"), F.round(F.get("quantiles", F.lit(2)), 6).alias("q50"))


@query(
    "t_shared_features",
    f"""WITH {PROFILE}, q AS (SELECT l.o_custkey AS id_l, r.o_custkey AS id_r, l.* EXCLUDE o_custkey, COLUMNS(r.*) AS 'r_\\0' FROM un l JOIN un r ON r.o_custkey > l.o_custkey AND r.o_custkey <= l.o_custkey + 3)
SELECT id_l, id_r, round(len(list_intersect(parties, r_parties)) / len(list_distinct(list_concat(parties, r_parties))), 6) AS party_jaccard,
 (len(parties) = 1 AND len(r_parties) = 1 AND parties <> r_parties)::INT::DOUBLE AS single_party_conflict, greatest(0, greatest(first_year, r_first_year) - least(last_year, r_last_year))::DOUBLE AS year_gap,
 (greatest(first_year, r_first_year) <= least(last_year, r_last_year))::INT::DOUBLE AS years_overlap, CASE WHEN median_value > 0 AND r_median_value > 0 THEN round(least(median_value, r_median_value) / greatest(median_value, r_median_value), 6) END AS median_ratio,
 (modal_value = r_modal_value)::INT::DOUBLE AS modal_equal, len(list_intersect(string_split(top_values, ' | '), string_split(r_top_values, ' | ')))::DOUBLE AS shared_amounts, round(abs(share_round - r_share_round), 6) AS round_share_gap,
 round((abs(quantiles[1] - r_quantiles[1]) + abs(quantiles[2] - r_quantiles[2]) + abs(quantiles[3] - r_quantiles[3]) + abs(quantiles[4] - r_quantiles[4]) + abs(quantiles[5] - r_quantiles[5])) / 5, 6) AS quantile_distance,
 (n = 1 AND r_n = 1)::INT::DOUBLE AS both_single, round(log10(1 + least(n, r_n)), 6) AS log_size_min, round(log10(1 + greatest(n, r_n)), 6) AS log_size_max FROM q""",
)
def t_shared_features(spark, d):
    u = _profiles(spark, d).withColumn("unit_size", F.col("n"))
    columns = [c for c in u.columns if c != "o_custkey"]
    l, r = (u.select(F.col("o_custkey").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in "lr")
    # each unit with the three that follow: an equality join on the following numbers
    pairs = l.withColumn("id_r", F.explode(F.array(*[F.col("id_l") + k for k in (1, 2, 3)]))).join(r, "id_r")
    return pairs.select("id_l", "id_r", *[F.round(c, 6).alias(n) for n, c in X.shared_features().items()])


@query("t_equal_differs", "SELECT p_partkey, (p_size = nullif(p_partkey % 20, 0))::INT::DOUBLE AS same, (p_size <> nullif(p_partkey % 20, 0))::INT::DOUBLE AS differs, (p_partkey % 20 = 0)::INT::DOUBLE AS one_sided FROM part")
def t_equal_differs(spark, d):
    l, r = F.col("p_size"), F.expr("nullif(p_partkey % 20, 0)")
    return table(spark, d, "part").select("p_partkey", X.equal(l, r).alias("same"), X.differs(l, r).alias("differs"), X.one_sided(l, r).alias("one_sided"))


@query("t_kind_code", "SELECT c_custkey, CASE WHEN a = b THEN a ELSE 9 END::DOUBLE AS kind FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS a, CASE WHEN c_nationkey < 9 THEN 1 WHEN c_nationkey < 15 THEN 2 ELSE 0 END AS b FROM customer)")
def t_kind_code(spark, d):
    other = F.when(F.col("c_nationkey") < 9, " Building").when(F.col("c_nationkey") < 15, "machinery").otherwise("x")
    return table(spark, d, "customer").select("c_custkey", X.kind_code(F.col("c_mktsegment"), other, {"building": 1, "machinery": 2}, 0, 9).alias("kind"))


FREQ = """nm AS (SELECT string_split(p_name, ' ')[1] AS f, string_split(p_name, ' ')[-1] AS s FROM part), fq AS (SELECT 'forename' AS kind, f AS forename, NULL AS surname, count(*) AS n FROM nm GROUP BY f UNION ALL SELECT 'surname', NULL, s, count(*) FROM nm GROUP BY s UNION ALL SELECT 'full', f, s, count(*) FROM nm GROUP BY f, s)"""


def _frequencies(spark, d):
    w = F.split("p_name", " ")
    return X.name_frequencies(table(spark, d, "part").select(F.get(w, F.lit(0)).alias("f"), F.element_at(w, -1).alias("s")), "f", "s")


@query("s_name_frequencies", f"WITH {FREQ} SELECT * FROM fq UNION ALL SELECT 'total_' || kind, NULL, NULL, sum(n)::BIGINT FROM fq GROUP BY kind")
def s_name_frequencies(spark, d):
    return _frequencies(spark, d)


@query("t_log_frequency", f"WITH {FREQ}, q AS (SELECT a.p_partkey AS id_l, string_split(a.p_name, ' ')[1] AS x, string_split(b.p_name, ' ')[1] AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) SELECT id_l, CASE WHEN x = y THEN round(log10(n), 6) END AS forename_log_n FROM q LEFT JOIN fq ON kind = 'forename' AND forename = x")
def t_log_frequency(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("f"))
    pairs = p.select(F.col("p_partkey").alias("id_l"), F.col("f").alias("x")).join(p.select((F.col("p_partkey") - 1).alias("id_l"), F.col("f").alias("y")), "id_l")
    return X.log_frequency(pairs, _frequencies(spark, d), "x", "y", "forename").select("id_l", F.round("forename_log_n", 6).alias("forename_log_n"))


@query(
    "t_co_controller",
    """WITH h AS (SELECT DISTINCT l_suppkey AS u, l_orderkey AS c FROM lineitem), q AS (SELECT s_suppkey AS id_l, s_suppkey + 1 AS id_r FROM supplier), rc AS (SELECT DISTINCT a.u, b.u AS t FROM h a JOIN h b ON a.c = b.c AND a.u <> b.u)
SELECT id_l, id_r, CASE WHEN EXISTS (SELECT 1 FROM rc a JOIN rc b ON a.t = b.t WHERE a.u = id_l AND b.u = id_r) THEN 1.0 ELSE 0.0 END::DOUBLE AS co FROM q""",
)
def t_co_controller(spark, d):
    pairs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id_l"), (F.col("s_suppkey") + 1).alias("id_r"))
    return X.co_controlled(pairs, table(spark, d, "lineitem"), "l_suppkey", "l_orderkey")


@query(
    "t_training_set",
    """WITH a AS (SELECT c_custkey AS id_l, c_custkey + 1 AS id_r, c_custkey % 2 = 0 AS same FROM customer), x AS (SELECT *, 'human' AS source, 1.0 AS weight, 0 AS o FROM a WHERE id_l % 3 = 0 UNION ALL SELECT id_l, id_r, true, 'import', 0.5, 1 FROM a), f AS (SELECT id_l, id_r, min_by(same, o) AS same, min_by(source, o) AS source, min_by(weight, o)::DOUBLE AS weight FROM x GROUP BY ALL)
SELECT *, CASE WHEN id_l % 12 = 0 THEN 'test' ELSE 'train' END AS split FROM f""",
)
def t_training_set(spark, d):
    k = F.col("c_custkey")
    a = table(spark, d, "customer").select(k.alias("id_l"), (k + 1).alias("id_r"), (k % 2 == 0).alias("same"))
    return X.training_set([("human", a.where("id_l % 3 = 0"), 1.0), ("import", a.withColumn("same", F.lit(True)), 0.5)], a.where("id_l % 12 = 0"))


# ------------------------------------------------------------ grading

LINE_SQL = """c AS (SELECT s, count(*) AS n, count(*) FILTER (y) AS h FROM rr GROUP BY s), k AS (SELECT *, sum(n) OVER (ORDER BY s DESC) AS above, sum(h) OVER (ORDER BY s DESC) AS ha, sum(n) OVER () AS every, sum(h) OVER () AS hits FROM c)"""
HARD = "rr AS (SELECT round(l_quantity / 50, 2) AS s, l_quantity + (l_partkey * 7 % 20) > 35 AS y FROM lineitem)"


def _graded(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.round(q / 50, 2).alias("s"), (q + F.col("l_partkey") * 7 % 20 > 35).alias("y"))


def _low(x, n):
    return f"(({x}/{n} + 3.8416/(2*{n}))/(1 + 3.8416/{n}) - 1.96*sqrt({x}/{n}*(1-{x}/{n})/{n} + 3.8416/(4*{n}*{n}))/(1 + 3.8416/{n}))"


@query(
    "t_lines",
    f"""WITH {HARD}, {LINE_SQL}, m AS (SELECT min(s) FILTER ({_low('ha', 'above')} >= 0.9) AS accept, max(s) FILTER (every > above AND {_low('((every-hits)-(above-ha))', 'nullif(every-above,0)')} >= 0.9) AS reject FROM k) SELECT accept, CASE WHEN accept IS NULL OR reject <= accept THEN reject END AS reject FROM m""",
)
def t_lines(spark, d):
    return T.lines(_graded(spark, d), "s", "y", 0.9)


@query("z_separation", f"WITH {HARD}, {LINE_SQL}, m AS (SELECT min(s) FILTER (ha / above >= 0.95) AS accept, max(s) FILTER (every > above AND ((every - hits) - (above - ha)) >= 0.95 * (every - above)) AS reject FROM k) SELECT accept, reject, count(*) FILTER (rr.s >= accept) AS n_accept, count(*) FILTER (rr.s < reject) AS n_reject, count(*) AS n FROM rr, m GROUP BY accept, reject")
def z_separation(spark, d):
    rows = _graded(spark, d)
    return T.separation(rows, "s", "y", rows, 0.95)


@query("t_average_precision", f"WITH {HARD}, {LINE_SQL} SELECT round(sum(h / hits * ha / above), 6) AS average_precision FROM k")
def t_average_precision(spark, d):
    return T.average_precision(_graded(spark, d), "s", "y")


@query("z_calibration_error", f"WITH {SCORES}, b AS (SELECT count(*) AS n, avg(s) AS m, avg(y::INT) AS r FROM r GROUP BY least(floor(s * 10), 9)) SELECT round(sum(n * abs(r - m)) / sum(n), 6) AS ece FROM b")
def z_calibration_error(spark, d):
    return T.calibration_error(_truths(spark, d), "s", "y")


@query("z_at_line", f"WITH {HARD}, t AS (SELECT count(*) FILTER (s >= 0.6 AND y) AS tp, count(*) FILTER (s >= 0.6 AND NOT y) AS fp, count(*) FILTER (s < 0.6 AND y) AS fn FROM rr) SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM t")
def z_at_line(spark, d):
    return T.at_line(_graded(spark, d), "s", "y", 0.6)


@query(
    "z_monotone_rate",
    """WITH rr AS (SELECT l_orderkey * 10 + l_linenumber AS k, round(l_quantity / 50, 2) AS s, l_quantity + (l_partkey * 7 % 20) > 35 AS y FROM lineitem), q AS (SELECT *, ntile(10) OVER (ORDER BY s, k) AS q FROM rr), b AS (SELECT q, avg(s) AS m, avg(y::INT) AS r FROM q GROUP BY q),
z AS (SELECT rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2 AS a, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2 AS b, r - lag(r) OVER (ORDER BY q) AS step FROM b) SELECT round(corr(a, b), 6) AS rho, min(step) >= -1e-9 AS rising FROM z""",
)
def z_monotone_rate(spark, d):
    return T.monotone_rate(_graded(spark, d), "s", "y", "k")


@query("z_bimodality", f"WITH {HARD}, t AS (SELECT avg(s) AS mu, count(*) AS n, avg((s < 0.05 OR s > 0.95)::INT) AS extreme, avg((s >= 0.4 AND s < 0.7)::INT) AS middle FROM rr), mo AS (SELECT avg(pow(s - mu, 2)) AS m2, avg(pow(s - mu, 3)) AS m3, avg(pow(s - mu, 4)) AS m4 FROM rr, t) SELECT round((pow(m3, 2) / pow(m2, 3) + 1) / (m4 / pow(m2, 2) - 3 + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))), 6) AS bc, round(extreme, 6) AS extreme, round(middle, 6) AS middle FROM t, mo")
def z_bimodality(spark, d):
    return T.bimodality(_graded(spark, d), "s")


@query("z_kappa", "WITH v AS (SELECT l_returnflag = 'R' AS a, l_returnflag <> 'N' AS b FROM lineitem), c AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS s, count(*) FILTER (a) AS a1, count(*) FILTER (b) AS b1 FROM v), p AS (SELECT s / n AS po, (a1 * b1 + (n - a1) * (n - b1)) / n / n AS pe FROM c) SELECT round(po, 6) AS agree, round((po - pe) / (1 - pe), 6) AS kappa FROM p")
def z_kappa(spark, d):
    f = F.col("l_returnflag")
    return T.kappa(table(spark, d, "lineitem").select((f == "R").alias("a"), (f != "N").alias("b")), "a", "b")


@query("z_confusion", "SELECT l_linestatus AS truth, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def z_confusion(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("truth")).pivot("l_returnflag", ["A", "N", "R"]).count()
    return p.select("truth", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "ANR"])


@query("z_top_candidate", "SELECT l_orderkey, max_by(l_partkey, (l_quantity, -l_linenumber, l_partkey, l_returnflag)) AS best, max_by(l_returnflag = 'R', (l_quantity, -l_linenumber, l_partkey, l_returnflag)) AS hit FROM lineitem GROUP BY 1")
def z_top_candidate(spark, d):
    best = F.max_by(F.struct("l_partkey", (F.col("l_returnflag") == "R").alias("hit")), F.struct("l_quantity", -F.col("l_linenumber"), "l_partkey", "l_returnflag"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(best.alias("x")).select("l_orderkey", F.col("x.l_partkey").alias("best"), "x.hit")
