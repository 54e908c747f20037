"""All queries of the engine and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from samewise.operators import listing as I
from samewise.operators import loading as N
from samewise.functions import similarity as S
from samewise.functions import text as X
from samewise.operators import blocking as B
from samewise.operators import clusters as G
from samewise.operators import conditions as P
from samewise.operators import decisions as D
from samewise.operators import exact as M
from samewise.operators import reconcile as R
from samewise.operators import registry as Y
from samewise.operators import scoring as W
from samewise.operators import training as T
from samewise.operators.graph import connected_components

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c):
    return c.cast("long")


# ------------------------------------------------------------ sources and projections

@query(
    "s_json_projection",
    "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL",
)
def s_json_projection(spark, d):
    rows = N.json_fields(table(spark, d, "events"), "props", {"k": "$.k"})
    return rows.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("s_projection_scan", "SELECT doc_id, source FROM documents WHERE lang = 'en'")
def s_projection_scan(spark, d):
    return N.projected(table(spark, d, "documents"), {"doc_id": F.col("doc_id"), "source": F.col("source")}, F.col("lang") == "en")


@query(
    "l_stable_record_key",
    "SELECT event_id, substr(sha256(concat_ws('|', user_id::VARCHAR, event_type, coalesce(props, ''))), 1, 16) AS record_key FROM events",
)
def l_stable_record_key(spark, d):
    return table(spark, d, "events").select("event_id", N.stable_key([F.col(x) for x in ("user_id", "event_type", "props")]).alias("record_key"))


@query(
    "l_modal_value",
    "SELECT o_custkey, o_orderpriority FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, min(o_orderkey)) AS r FROM orders GROUP BY o_custkey, o_orderpriority) WHERE r = 1",
)
def l_modal_value(spark, d):
    return M.modal_values(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@query(
    "l_distinct_join",
    "SELECT user_id, string_agg(DISTINCT event_type, ' | ' ORDER BY event_type) AS kinds FROM events GROUP BY user_id",
)
def l_distinct_join(spark, d):
    return N.distinct_join(table(spark, d, "events"), "user_id", {"kinds": "event_type"})


@query(
    "l_amount_profile",
    """SELECT o_custkey, count(*) AS n, count(DISTINCT o_totalprice) AS n_amounts, round(median(o_totalprice), 6) AS median_value, max(o_totalprice) AS largest,
       round(avg(CASE WHEN o_totalprice > 0 AND o_totalprice % 1000 = 0 THEN 1 ELSE 0 END), 6) AS share_round_1000 FROM orders GROUP BY o_custkey""",
)
def l_amount_profile(spark, d):
    v = F.col("o_totalprice")
    return (
        table(spark, d, "orders")
        .groupBy("o_custkey")
        .agg(F.count("*").alias("n"), F.count_distinct(v).alias("n_amounts"), F.round(F.median(v), 6).alias("median_value"), F.max(v).alias("largest"), F.round(F.avg(F.when((v > 0) & (v % 1000 == 0), 1).otherwise(0)), 6).alias("share_round_1000"))
    )


@query("l_year_range", "SELECT o_custkey, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year, count(*) AS n FROM orders GROUP BY o_custkey")
def l_year_range(spark, d):
    return N.year_range(table(spark, d, "orders"), "o_custkey", "o_orderdate")


# ------------------------------------------------------------ cleaning and functions

def _names(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")


TEXT = {
    "c_upper": ("p_name", F.upper, "upper(p_name)"),
    "c_trim": ("p_name", lambda c: X.trim(F.concat(F.lit(" \t"), c, F.lit("  "))), "p_name"),
    "c_collapse_spaces": ("p_type", lambda c: X.collapse_spaces(F.concat(c, F.lit("   x "))), "p_type || ' x'"),
    "c_strip_punctuation": ("p_brand", lambda c: X.strip_punctuation(F.concat(c, F.lit(".-_/!"))), r"regexp_replace(p_brand || '.-_/!', '[^\p{L}\p{N} ]', '', 'g')"),
    "c_regex_replace": ("p_brand", lambda c: X.step("regex_replace", c, pattern=r"^Brand#(\d)(\d)$", replacement="$2$1"), r"regexp_replace(p_brand, '^Brand#(\d)(\d)$', '\2\1')"),
    "c_nullify": ("p_brand", lambda c: X.nullify(c, ["brand#11", "Brand#22"]), "CASE WHEN upper(p_brand) IN ('BRAND#11', 'BRAND#22') THEN NULL ELSE p_brand END"),
    "c_strip_tokens": ("p_type", lambda c: X.strip_tokens(c, ["tin", "nickel", "brass", "steel", "copper"]), r"regexp_replace(p_type, '(?i)(\s+(?:tin|nickel|brass|steel|copper))+$', '')"),
    "c_lookup": ("p_brand", lambda c: X.lookup(c, {"BRAND#11": "eleven"}), "CASE WHEN upper(p_brand) = 'BRAND#11' THEN 'eleven' ELSE p_brand END"),
    "f_sorted_tokens": ("p_name", X.sorted_tokens, "nullif(array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' '), '')"),
    "f_token_set": ("p_name", X.token_set, "nullif(array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' | '), '')"),
    "f_first_token": ("p_name", X.first_token, "string_split(p_name, ' ')[1]"),
    "f_last_token": ("p_name", X.last_token, "string_split(p_name, ' ')[-1]"),
    "f_initials": ("p_type", X.initials, "array_to_string(list_transform(string_split(p_type, ' '), lambda w: substr(w, 1, 1)), '')"),
    "f_company_number": ("p_partkey", lambda c: X.company_number(c.cast("string")), "CASE WHEN length(p_partkey::VARCHAR) < 2 THEN NULL WHEN length(p_partkey::VARCHAR) < 8 THEN lpad(p_partkey::VARCHAR, 8, '0') ELSE p_partkey::VARCHAR END"),
}


def _text_query(name):
    column, build, sql = TEXT[name]

    def run(spark, d):
        return table(spark, d, "part").select("p_partkey", build(F.col(column)).alias("value"))

    query(name, f"SELECT p_partkey, {sql} AS value FROM part")(run)


for _n in TEXT:
    _text_query(_n)


@query(
    "c_accent_fold",
    "SELECT doc_id, md5(strip_accents(nfc_normalize(lower(text)))) AS folded FROM documents",
)
def c_accent_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.accent_fold(F.lower("text"))).alias("folded"))


@query("c_nullify_outside_range", "SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 40 THEN p_size END AS size_kept FROM part")
def c_nullify_outside_range(spark, d):
    return table(spark, d, "part").select("p_partkey", X.nullify_outside(F.col("p_size"), 10, 40).alias("size_kept"))


@query("c_concat_keys", "SELECT s_suppkey, s_nationkey::VARCHAR || '|' || s_name AS key FROM supplier")
def c_concat_keys(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", X.concat_keys([F.col("s_nationkey").cast("string"), F.col("s_name")]).alias("key"))


# ------------------------------------------------------------ conditions, tracks, derived columns

CONDITIONS = {
    "p_equals": ({"column": "c_mktsegment", "op": "equals", "value": " building "}, "upper(c_mktsegment) = 'BUILDING'"),
    "p_not_in": ({"column": "c_mktsegment", "op": "not_in", "values": ["BUILDING", "machinery"]}, "upper(c_mktsegment) NOT IN ('BUILDING', 'MACHINERY')"),
    "p_starts_with": ({"column": "c_mktsegment", "op": "starts_with", "values": ["b", "HOUSE"]}, "upper(c_mktsegment) SIMILAR TO '(B|HOUSE).*'"),
    "p_contains_token": ({"column": "c_mktsegment", "op": "contains_token", "values": ["machinery", "furniture"]}, "upper(c_mktsegment) IN ('MACHINERY', 'FURNITURE')"),
    "p_matches": ({"column": "c_name", "op": "matches", "value": "[02468]$"}, "regexp_matches(c_name, '[02468]$')"),
    "p_is_null": ({"column": "c_mktsegment", "op": "is_null"}, "c_mktsegment IS NULL OR trim(c_mktsegment) = ''"),
}


def _condition_query(name):
    spec, sql = CONDITIONS[name]

    def run(spark, d):
        df = table(spark, d, "customer")
        return df.select("c_custkey", P.condition(df, spec).alias("holds"))

    query(name, f"SELECT c_custkey, coalesce({sql}, false) AS holds FROM customer")(run)


for _n in CONDITIONS:
    _condition_query(_n)


@query(
    "p_track_assignment",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey = 1 THEN 'organisation' WHEN c_mktsegment = 'MACHINERY' THEN 'organisation' ELSE 'person' END AS track,
       CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey = 1 THEN 0 WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE -1 END AS track_rule FROM customer""",
)
def p_track_assignment(spark, d):
    rules = [
        {"track": "organisation", "when": [{"column": "c_mktsegment", "op": "equals", "value": "building"}, {"column": "c_nationkey", "op": "equals", "value": "1"}]},
        {"track": "organisation", "when": [{"column": "c_mktsegment", "op": "equals", "value": "machinery"}]},
    ]
    return P.assign_tracks(table(spark, d, "customer"), rules, "person").select("c_custkey", "track", "track_rule")


@query(
    "p_derived_transitions",
    "SELECT lang AS \"from\", 'western' AS \"to\", count(*) AS n FROM documents WHERE lang IN ('de', 'fr') GROUP BY lang",
)
def p_derived_transitions(spark, d):
    docs = table(spark, d, "documents")
    out = P.derive(docs, "region", "lang", [{"value": "western", "when": [{"column": "lang", "op": "in", "values": ["de", "fr"]}]}])
    return P.transitions(out, "lang", "region")


@query(
    "c_two_track_clean",
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'organisation' ELSE 'person' END AS track, CASE WHEN c_mktsegment = 'BUILDING' THEN lower(c_name) END AS org_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN upper(c_name) END AS person_name FROM customer",
)
def c_two_track_clean(spark, d):
    tracked = P.assign_tracks(table(spark, d, "customer"), [{"track": "organisation", "when": [{"column": "c_mktsegment", "op": "equals", "value": "BUILDING"}]}], "person")
    steps = {"organisation": [{"source": "c_name", "target": "org_name", "op": "lower"}], "person": [{"source": "c_name", "target": "person_name", "op": "upper"}]}
    return P.clean_tracks(tracked, steps).select("c_custkey", "track", "org_name", "person_name")


# ------------------------------------------------------------ exact match and units

NORM_SQL = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))"


def _records(spark, d):
    norm = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), norm.alias("norm"), F.array_join(F.array_sort(F.array_distinct(F.split(norm, " "))), " ").alias("bag"), "lang", "source")


RECORDS = f"records AS (SELECT doc_id::VARCHAR AS record_id, {NORM_SQL} AS norm, array_to_string(list_sort(list_distinct(string_split({NORM_SQL}, ' '))), ' ') AS bag, lang, source FROM documents)"
KEYS = [M.MatchKey("text", ["norm"], 1), M.MatchKey("bag", ["source", "bag"], 2, max_distinct=("lang", 1), max_group_size=3)]
MEMBERS_SQL = f"""{RECORDS},
g1 AS (SELECT norm, count(*) AS n, min(record_id) AS head FROM records WHERE norm <> '' GROUP BY norm HAVING count(*) >= 2),
g2 AS (SELECT source, bag, count(*) AS n, min(record_id) AS head, count(DISTINCT lang) AS d FROM records WHERE bag <> '' AND trim(source) <> '' GROUP BY ALL HAVING count(*) >= 2),
mem AS (SELECT 'text' AS key_id, head, record_id, NULL AS guard FROM records JOIN g1 USING (norm)
  UNION ALL SELECT 'bag', head, record_id, CASE WHEN n > 3 THEN 'max_group_size:' || n || '>3' WHEN d > 1 THEN 'max_distinct:lang=' || d || '>1' END FROM records JOIN g2 USING (source, bag))"""
CC_SQL = """e AS (SELECT DISTINCT head AS a, record_id AS b FROM mem WHERE guard IS NULL UNION SELECT record_id, head FROM mem WHERE guard IS NULL),
reach AS (SELECT a AS node, b AS other FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
cc AS (SELECT node, least(min(other), node) AS component FROM reach GROUP BY node)"""


def FLAGSHIP(spark, d):
    return m_exact_groups(spark, d)


@query(
    "m_exact_groups",
    f"""WITH RECURSIVE {MEMBERS_SQL}, {CC_SQL},
ids AS (SELECT component, CASE WHEN bool_or(key_id = 'text') AND bool_or(key_id = 'bag') THEN 'text|bag' WHEN bool_or(key_id = 'text') THEN 'text' ELSE 'bag' END AS key_ids FROM mem JOIN cc ON cc.node = mem.record_id WHERE guard IS NULL GROUP BY component)
SELECT node AS record_id, 'X-' || component AS group_id, 'merged' AS status, key_ids, NULL::VARCHAR AS guard FROM cc JOIN ids USING (component)
UNION ALL SELECT record_id, 'H-' || key_id || '-' || head, 'held', key_id, guard FROM mem WHERE guard IS NOT NULL""",
)
def m_exact_groups(spark, d):
    return M.exact_groups(_records(spark, d), KEYS)


@query(
    "m_key_statistics",
    f"WITH {MEMBERS_SQL} SELECT key_id, count(DISTINCT head) AS n_groups, count(*) AS n_records, count(guard) AS n_held FROM mem GROUP BY key_id",
)
def m_key_statistics(spark, d):
    return M.key_members(_records(spark, d), KEYS).groupBy("key_id").agg(F.count_distinct("head").alias("n_groups"), F.count("*").alias("n_records"), F.count("guard").alias("n_held"))


@query(
    "u_unit_membership",
    f"WITH RECURSIVE {MEMBERS_SQL}, {CC_SQL} SELECT record_id, coalesce(component, record_id) AS unit_id FROM records LEFT JOIN cc ON cc.node = record_id",
)
def u_unit_membership(spark, d):
    r = _records(spark, d)
    return M.units(r, M.exact_groups(r, KEYS))


@query(
    "u_modal_representative",
    f"""WITH RECURSIVE {MEMBERS_SQL}, {CC_SQL}, u AS (SELECT records.*, coalesce(component, record_id) AS unit_id FROM records LEFT JOIN cc ON cc.node = record_id),
v AS (SELECT unit_id, source, row_number() OVER (PARTITION BY unit_id ORDER BY count(*) DESC, min(record_id)) AS r FROM u WHERE source IS NOT NULL GROUP BY unit_id, source)
SELECT unit_id, source FROM v WHERE r = 1""",
)
def u_modal_representative(spark, d):
    r = _records(spark, d)
    return M.modal_values(r.join(M.units(r, M.exact_groups(r, KEYS)), "record_id"), "unit_id", "source")


@query(
    "m_group_evaluation",
    f"""WITH g AS (SELECT {NORM_SQL} AS k, source AS label FROM documents), n AS (SELECT coalesce(sum(c * (c - 1) // 2), 0)::BIGINT AS p FROM (SELECT count(*) AS c FROM g GROUP BY k, label)),
f AS (SELECT coalesce(sum(c * (c - 1) // 2), 0)::BIGINT AS p FROM (SELECT count(*) AS c FROM g GROUP BY k)), r AS (SELECT coalesce(sum(c * (c - 1) // 2), 0)::BIGINT AS p FROM (SELECT count(*) AS c FROM g GROUP BY label))
SELECT n.p AS true_pairs, f.p AS found_pairs, r.p AS label_pairs, round(n.p / f.p, 6) AS precision, round(n.p / r.p, 6) AS recall FROM n, f, r""",
)
def m_group_evaluation(spark, d):
    return D.pair_figures(_records(spark, d), "norm", "source")


# ------------------------------------------------------------ blocking

@query(
    "b_rule_pricing",
    "SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT AS pairs FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)",
)
def b_rule_pricing(spark, d):
    return B.price(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query(
    "b_rule_pricing_differs",
    "SELECT ((SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)) - (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)))::BIGINT AS pairs",
)
def b_rule_pricing_differs(spark, d):
    return B.price(table(spark, d, "customer"), ["c_nationkey"], differ="c_mktsegment")


@query(
    "b_hot_key_control",
    """WITH s AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), a AS (SELECT o_orderpriority, sum(n)::BIGINT AS n FROM s GROUP BY 1)
SELECT block, n FROM (SELECT o_orderpriority AS block, n FROM a WHERE n <= 100 UNION ALL SELECT s.o_orderpriority || chr(31) || s.o_orderstatus, s.n FROM s JOIN a USING (o_orderpriority) WHERE a.n > 100)""",
)
def b_hot_key_control(spark, d):
    return B.control_hot_keys(table(spark, d, "orders"), ["o_orderpriority"], 100, ["o_orderstatus"]).groupBy("block").agg(F.count("*").alias("n"))


def _suppliers(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 500).cast("long").alias("band"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))


SUPPLIERS = "s AS (SELECT s_suppkey::VARCHAR AS id, s_nationkey AS nation, floor(s_acctbal / 500)::BIGINT AS band, s_acctbal AS balance, s_name AS name FROM supplier)"
PAIRS = f"""{SUPPLIERS}, p AS (SELECT a.id AS id_l, b.id AS id_r, CASE WHEN a.nation = b.nation THEN 0 ELSE 1 END AS match_key, a.balance AS bl, b.balance AS br, a.nation AS nl, b.nation AS nr, a.band AS dl, b.band AS dr, a.name AS ml, b.name AS mr
 FROM s a JOIN s b ON a.id < b.id AND (a.nation = b.nation OR a.band = b.band))"""
RULES = [["nation"], ["band"]]


def _pairs(spark, d):
    return B.pairs(_suppliers(spark, d), RULES, "id", ["balance", "nation", "band", "name"])


@query("b_rule_union", f"WITH {PAIRS} SELECT id_l, id_r, match_key::BIGINT AS match_key FROM p")
def b_rule_union(spark, d):
    return _pairs(spark, d).select("id_l", "id_r", "match_key")


# ------------------------------------------------------------ comparison levels and scoring

COMPARISONS = [W.Comparison("nation"), W.Comparison("balance", "numeric", [0, 50, 1000]), W.Comparison("name", "levenshtein", [1, 2])]
GAMMAS = f"""{PAIRS}, g AS (SELECT id_l, id_r, CASE WHEN nl = nr THEN 1 ELSE 0 END AS gamma_nation,
 CASE WHEN abs(bl - br) <= 0 THEN 3 WHEN abs(bl - br) <= 50 THEN 2 WHEN abs(bl - br) <= 1000 THEN 1 ELSE 0 END AS gamma_balance,
 CASE WHEN ml = mr THEN 3 WHEN levenshtein(ml, mr) <= 1 THEN 2 WHEN levenshtein(ml, mr) <= 2 THEN 1 ELSE 0 END AS gamma_name FROM p)"""


def _levels():
    # the numeric comparison counts from its loosest limit, the others from theirs to equality
    return COMPARISONS


def _gammas(spark, d):
    return W.gammas(_pairs(spark, d), _levels())


@query("w_comparison_levels", f"WITH {GAMMAS} SELECT * FROM g")
def w_comparison_levels(spark, d):
    return _gammas(spark, d)


@query("w_gamma_counts", f"WITH {GAMMAS} SELECT gamma_nation, gamma_balance, gamma_name, count(*) AS n FROM g GROUP BY ALL")
def w_gamma_counts(spark, d):
    return W.gamma_counts(_gammas(spark, d), _levels())


MODEL = W.Model(0.125, {"nation": [0.25, 0.75], "balance": [0.1, 0.2, 0.3, 0.4], "name": [0.1, 0.1, 0.3, 0.5]}, {"nation": [0.75, 0.25], "balance": [0.4, 0.3, 0.2, 0.1], "name": [0.5, 0.3, 0.15, 0.05]})


def _weights_sql():
    parts = ["log2(0.125 / 0.875)"]
    for c in COMPARISONS:
        whens = " ".join(f"WHEN {k} THEN log2({MODEL.m[c.column][k]} / {MODEL.u[c.column][k]})" for k in range(c.levels))
        parts.append(f"CASE gamma_{c.column} {whens} ELSE 0 END")
    return " + ".join(parts)


SCORED = f"{GAMMAS}, w AS (SELECT id_l, id_r, {_weights_sql()} AS weight FROM g), sc AS (SELECT id_l, id_r, round(weight, 6) AS match_weight, round(pow(2, weight) / (1 + pow(2, weight)), 6) AS match_probability FROM w)"


def _scored(spark, d):
    out = W.score(_gammas(spark, d), _levels(), MODEL)
    return out.select("id_l", "id_r", F.round("match_weight", 6).alias("match_weight"), F.round("match_probability", 6).alias("match_probability"))


@query("w_match_weight", f"WITH {SCORED} SELECT * FROM sc")
def w_match_weight(spark, d):
    return _scored(spark, d)


@query("w_em_training")
def w_em_training(spark, d):
    m = W.train(W.gamma_counts(_gammas(spark, d), _levels()), _levels())
    rows = [(n, k, round(m.m[n][k], 9), round(m.u[n][k], 9)) for n in m.m for k in range(len(m.m[n]))]
    return spark.createDataFrame(rows, "column string, level int, m double, u double")


# ------------------------------------------------------------ buckets, vetoes, overlays

@query("v_bucket", f"WITH {SCORED} SELECT id_l, id_r, CASE WHEN match_probability >= 0.5 THEN 'accept' WHEN match_probability >= 0.1 THEN 'review' ELSE 'reject' END AS bucket FROM sc")
def v_bucket(spark, d):
    return _scored(spark, d).select("id_l", "id_r", D.bucket(F.col("match_probability"), 0.1, 0.5).alias("bucket"))


@query(
    "v_vetoes",
    f"""WITH {PAIRS}, b AS (SELECT *, CASE WHEN abs(bl - br) <= 400 THEN 'accept' ELSE 'review' END AS bucket FROM p)
SELECT id_l, id_r, CASE WHEN nl <> nr THEN 'reject' WHEN abs(bl - br) > 200 AND bucket = 'accept' THEN 'review' ELSE bucket END AS bucket,
 CASE WHEN nl <> nr THEN 'nation' WHEN abs(bl - br) > 200 THEN 'gap' END AS veto_id FROM b""",
)
def v_vetoes(spark, d):
    c = F.col
    rows = _pairs(spark, d).withColumn("bucket", F.when(F.abs(c("balance_l") - c("balance_r")) <= 400, "accept").otherwise("review"))
    vetoes = [("gap", D.veto("abs_diff_gt", c("balance_l"), c("balance_r"), 200), "review"), ("nation", D.veto("differs", c("nation_l"), c("nation_r")), "reject")]
    return D.apply_vetoes(rows, vetoes).select("id_l", "id_r", "bucket", "veto_id")


@query("v_pair_counts", f"WITH {SCORED} SELECT count(*) FILTER (match_probability >= 0.5) AS accepted, count(*) FILTER (match_probability >= 0.1 AND match_probability < 0.5) AS review, count(*) AS total FROM sc")
def v_pair_counts(spark, d):
    p = F.col("match_probability")
    return I.facets(_scored(spark, d), {"accepted": p >= 0.5, "review": (p >= 0.1) & (p < 0.5)})


@query("h_latest_label", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def h_latest_label(spark, d):
    return D.latest(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


# ------------------------------------------------------------ clusters and entities

EDGES = "e0 AS (SELECT a.s_suppkey AS src, b.s_suppkey AS dst, abs(a.s_acctbal - b.s_acctbal) AS gap FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey), ed AS (SELECT src, dst FROM e0 WHERE gap <= 600)"
REACH = """both_ways AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed), reach AS (SELECT a AS node, b AS other FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.other = w.a),
cc AS (SELECT node, least(min(other), node) AS component FROM reach GROUP BY node)"""


def _edges(spark, d):
    s = table(spark, d, "supplier")
    l, r = (s.select(F.col("s_suppkey").alias(k), F.col("s_nationkey").alias(f"n{k}"), F.col("s_acctbal").alias(f"b{k}")) for k in ("src", "dst"))
    gap = F.abs(F.col("bsrc") - F.col("bdst"))
    return l.join(r, (F.col("nsrc") == F.col("ndst")) & (F.col("src") < F.col("dst"))).withColumn("gap", gap).where("gap <= 600").select("src", "dst", "gap")


@query("g_connected_components", f"WITH RECURSIVE {EDGES}, {REACH} SELECT node, component FROM cc")
def g_connected_components(spark, d):
    return connected_components(_edges(spark, d))


CLUSTERS = f"{EDGES}, {REACH}, mem AS (SELECT s_suppkey AS unit_id, 'C-' || coalesce(component, s_suppkey) AS cluster_id, s_suppkey % 3 AS existing_id FROM supplier LEFT JOIN cc ON node = s_suppkey)"


def _clusters(spark, d):
    u = table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit_id"))
    return G.clusters(u, _edges(spark, d)).withColumn("existing_id", F.col("unit_id") % 3)


@query("g_cluster_ids", f"WITH RECURSIVE {CLUSTERS} SELECT unit_id, cluster_id FROM mem")
def g_cluster_ids(spark, d):
    return _clusters(spark, d).select("unit_id", "cluster_id")


@query(
    "g_gate",
    f"""WITH RECURSIVE {CLUSTERS}, pr AS (SELECT src, dst, 1 - gap / 700 AS p FROM e0 WHERE gap <= 600), per AS (SELECT cluster_id, count(*) AS n_units, count(DISTINCT existing_id) AS n_ids FROM mem GROUP BY 1),
wk AS (SELECT m.cluster_id, min(p) AS weakest FROM pr JOIN mem m ON m.unit_id = src JOIN mem k ON k.unit_id = dst WHERE m.cluster_id = k.cluster_id GROUP BY 1),
f AS (SELECT cluster_id, n_units, n_units >= 2 AND n_units > 5 AS big, coalesce(n_units >= 2 AND weakest < 0.2, false) AS weak, n_units >= 2 AND n_ids > 1 AS mixed FROM per LEFT JOIN wk USING (cluster_id))
SELECT cluster_id, n_units, CASE WHEN big THEN 'too_large' WHEN weak THEN 'weak_link' WHEN mixed THEN 'mixed_ids' ELSE 'ok' END AS status,
 concat_ws('|', CASE WHEN big THEN 'too_large' END, CASE WHEN weak THEN 'weak_link' END, CASE WHEN mixed THEN 'mixed_ids' END) AS statuses FROM f""",
)
def g_gate(spark, d):
    scored = _edges(spark, d).select("src", "dst", (1 - F.col("gap") / 700).alias("p"))
    return G.gate(_clusters(spark, d), scored, max_units=5)


@query("g_import_star", "SELECT min(s_suppkey) OVER (PARTITION BY s_nationkey) AS src, s_suppkey AS dst FROM supplier QUALIFY src <> dst")
def g_import_star(spark, d):
    return G.import_stars(table(spark, d, "supplier"), "s_suppkey", "s_nationkey")


@query(
    "e_consensus",
    """WITH v AS (SELECT o_custkey, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT *, max(n) OVER (PARTITION BY o_custkey) AS top FROM v)
SELECT o_custkey, min(value) FILTER (n = top) AS value, CASE WHEN sum(n) = 1 THEN 'single' WHEN count(*) FILTER (n = top) > 1 THEN 'tie' ELSE 'majority' END AS basis, sum(n)::BIGINT AS n_votes FROM t GROUP BY o_custkey""",
)
def e_consensus(spark, d):
    return G.consensus(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("e_mint_counter", "SELECT c_name, 'E' || lpad(row_number() OVER (ORDER BY c_name)::VARCHAR, 8, '0') AS entity_id FROM customer")
def e_mint_counter(spark, d):
    return G.mint(table(spark, d, "customer"), "c_name")


# ------------------------------------------------------------ evaluation and read path

@query("d_score_histogram", "SELECT least(floor((c_acctbal + 1000) / 11000 * 20), 19)::BIGINT AS bin, count(*) AS n FROM customer GROUP BY bin")
def d_score_histogram(spark, d):
    return D.histogram(table(spark, d, "customer").withColumn("s", (F.col("c_acctbal") + 1000) / 11000), "s", 20)


@query(
    "t_threshold_grid",
    """WITH r AS (SELECT least(floor(l_discount * 10 * 20), 20)::BIGINT AS step, (l_returnflag = 'R')::BIGINT AS y FROM lineitem), c AS (SELECT step, count(*) AS n, sum(y)::BIGINT AS h FROM r GROUP BY step),
a AS (SELECT step, sum(n) OVER (ORDER BY step DESC)::BIGINT AS predicted, sum(h) OVER (ORDER BY step DESC)::BIGINT AS hits, sum(h) OVER ()::BIGINT AS every FROM c)
SELECT step / 20 AS threshold, predicted, hits, round(hits / predicted, 6) AS precision,
 round((hits / predicted + 1.96 * 1.96 / (2 * predicted)) / (1 + 1.96 * 1.96 / predicted) - 1.96 * sqrt(hits / predicted * (1 - hits / predicted) / predicted + 1.96 * 1.96 / (4 * predicted * predicted)) / (1 + 1.96 * 1.96 / predicted), 6) AS precision_low,
 round(hits / every, 6) AS recall FROM a""",
)
def t_threshold_grid(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("s"), (F.col("l_returnflag") == "R").alias("y"))
    return D.threshold_grid(rows, "s", "y")


@query("t_amount_quantiles", "SELECT o_custkey, round(quantile_cont(log10(o_totalprice + 1), 0.25), 6) AS q25, round(quantile_cont(log10(o_totalprice + 1), 0.75), 6) AS q75 FROM orders WHERE o_totalprice > 0 GROUP BY o_custkey")
def t_amount_quantiles(spark, d):
    v = F.log10(F.col("o_totalprice") + 1)
    q = lambda p: F.round(F.percentile(v, F.lit(p)), 6)
    return table(spark, d, "orders").where("o_totalprice > 0").groupBy("o_custkey").agg(q(0.25).alias("q25"), q(0.75).alias("q75"))


@query("r_records_page", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 100")
def r_records_page(spark, d):
    return I.page(table(spark, d, "customer"), [F.desc_nulls_last("c_acctbal"), "c_custkey"], 100, 50, columns=["c_custkey", "c_acctbal"])


@query("r_facet_counts", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_totalprice > 100000) AS large, count(DISTINCT o_custkey) AS customers FROM orders")
def r_facet_counts(spark, d):
    tests = {"finished": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 100000}
    return I.facets(table(spark, d, "orders"), tests, {"customers": "o_custkey"})


@query("r_unit_events", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 200")
def r_unit_events(spark, d):
    return N.event_projection(table(spark, d, "events"), "user_id", {"ts": F.col("ts")}, "ts", "event_id", 200).drop("position")


@query("j_link_only_exact", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND floor(c_acctbal / 100) = floor(s_acctbal / 100)")
def j_link_only_exact(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return c.join(s, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.floor(F.col("c_acctbal") / 100) == F.floor(F.col("s_acctbal") / 100))).select("c_custkey", "s_suppkey")


# ------------------------------------------------------------ similarity, reconciler, registry, training figures

@query("w_jaro_winkler", f"WITH {PAIRS}, t AS (SELECT id_l, id_r, ml || nl AS a, mr || nr AS b FROM p) SELECT id_l, id_r, round(jaro_winkler_similarity(a, b), 6) AS similarity FROM t")
def w_jaro_winkler(spark, d):
    a, b = (F.concat(F.col(f"name_{s}"), F.col(f"nation_{s}").cast("string")) for s in "lr")
    return _pairs(spark, d).select("id_l", "id_r", F.round(S.jaro_winkler_col(a, b), 6).alias("similarity"))


@query("w_jaccard", f"WITH {PAIRS}, t AS (SELECT id_l, id_r, list_distinct(string_split(ml, '')) AS a, list_distinct(string_split(mr, '')) AS b FROM p) SELECT id_l, id_r, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM t")
def w_jaccard(spark, d):
    return _pairs(spark, d).select("id_l", "id_r", F.round(W.jaccard(F.col("name_l"), F.col("name_r")), 6).alias("similarity"))


def _part_pairs(spark, d):
    p = table(spark, d, "part")
    l, r = (p.select("p_brand", "p_size", F.col("p_partkey").alias(f"id_{s}"), F.concat("p_name", F.lit(e)).alias(f"name_{s}")) for s, e in (("l", " Limited"), ("r", " (uk) company")))
    return l.join(r, ["p_brand", "p_size"]).where("id_l < id_r").select("id_l", "id_r", "name_l", "name_r")


def _named_parts(spark, d):
    rows = table(spark, d, "part").withColumns({"name_l": F.concat("p_name", F.lit(" Limited")), "name_r": F.concat("p_name", F.lit(" (uk) company"))})
    return rows, ["p_brand", "p_size"], "p_partkey", "name_l", "name_r"


X_SQL = """WITH q AS (SELECT a.p_partkey AS id_l, b.p_partkey AS id_r, upper(a.p_name) || ' LTD' AS l, upper(b.p_name) || ' CO' AS r, list_distinct(string_split(upper(a.p_name), ' ')) AS x, list_distinct(string_split(upper(b.p_name), ' ')) AS y
 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey), n AS (SELECT *, len(x) AS a, len(y) AS b, len(list_intersect(x, y)) AS c FROM q),
v AS (SELECT id_l, id_r, CASE WHEN l = r THEN 'TRUE|high' WHEN a = 0 OR b = 0 THEN 'FALSE|low' WHEN c = a AND c = b THEN 'TRUE|high' WHEN (c = a OR c = b) AND abs(a - b) <= 2 THEN 'TRUE|medium' WHEN c = a OR c = b THEN 'FALSE|medium' WHEN c >= 0.8 * least(a, b) THEN 'TRUE|medium' ELSE 'FALSE|high' END AS v FROM n)"""


@query("x_rule_verdicts", X_SQL + " SELECT id_l, id_r, split_part(v, '|', 1) AS verdict, split_part(v, '|', 2) AS confidence FROM v")
def x_rule_verdicts(spark, d):
    return R.block_verdicts(*_named_parts(spark, d)).select("id_l", "id_r", "verdict", "confidence")


@query("x_first_true", X_SQL + ", k AS (SELECT id_l, id_r, split_part(v, '|', 1) AS t, row_number() OVER (PARTITION BY id_l, split_part(v, '|', 1) ORDER BY id_r) AS n FROM v) SELECT id_l, id_r, CASE WHEN t = 'TRUE' AND n > 1 THEN 'FALSE' ELSE t END AS verdict FROM k")
def x_first_true(spark, d):
    return R.block_first_true(*_named_parts(spark, d))


@query(
    "v_human_overlay",
    f"""WITH {PAIRS}, b AS (SELECT id_l, id_r, CASE WHEN nl = nr THEN 'accept' ELSE 'reject' END AS bucket FROM p), h AS (SELECT s_suppkey::VARCHAR AS id_l, s_suppkey::VARCHAR || '0' AS id_r, s_suppkey % 2 = 0 AS same FROM supplier)
SELECT id_l, id_r, CASE WHEN same THEN 'accept' WHEN NOT same THEN 'reject' ELSE bucket END AS bucket, CASE WHEN same IS NULL THEN 'score' ELSE 'human' END AS decided_by FROM b FULL JOIN h USING (id_l, id_r)""",
)
def v_human_overlay(spark, d):
    scored = _pairs(spark, d).select("id_l", "id_r", F.when(F.col("nation_l") == F.col("nation_r"), "accept").otherwise("reject").alias("bucket"))
    k = F.col("s_suppkey").cast("string")
    labels = table(spark, d, "supplier").select(k.alias("id_l"), F.concat(k, F.lit("0")).alias("id_r"), (F.col("s_suppkey") % 2 == 0).alias("same"))
    return Y.human_overlay(scored, labels).select("id_l", "id_r", "bucket", "decided_by")


@query("h_pair_key", "SELECT l_orderkey, l_linenumber, least(l_partkey::VARCHAR, l_suppkey::VARCHAR) AS lo, greatest(l_partkey::VARCHAR, l_suppkey::VARCHAR) AS hi FROM lineitem WHERE l_partkey <> l_suppkey")
def h_pair_key(spark, d):
    rows = table(spark, d, "lineitem").withColumn("k", Y.ordered_pair(F.col("l_partkey"), F.col("l_suppkey"))).where("k IS NOT NULL")
    return rows.select("l_orderkey", "l_linenumber", "k.lo", "k.hi")


@query("h_decision_star", "SELECT min(o_orderkey) OVER (PARTITION BY o_custkey) AS src, o_orderkey AS dst FROM orders QUALIFY src <> dst")
def h_decision_star(spark, d):
    return Y.decision_star(table(spark, d, "orders"), "o_custkey", "o_orderkey")


@query(
    "e_alias_chain",
    "WITH RECURSIVE a AS (SELECT s_suppkey AS id, s_suppkey // 2 AS alias_of FROM supplier WHERE s_suppkey > 1), w AS (SELECT id, alias_of AS survivor FROM a UNION ALL SELECT w.id, a.alias_of FROM w JOIN a ON a.id = w.survivor) SELECT id, min(survivor) AS survivor FROM w GROUP BY id",
)
def e_alias_chain(spark, d):
    a = table(spark, d, "supplier").where("s_suppkey > 1").select(F.col("s_suppkey").alias("id"), F.expr("s_suppkey div 2").alias("alias_of"))
    return Y.resolve_aliases(a)


@query(
    "e_publish_plan",
    """WITH o AS (SELECT c_custkey AS r, c_nationkey AS e FROM customer WHERE c_acctbal > 0), n AS (SELECT c_custkey AS r, CASE WHEN c_mktsegment = 'BUILDING' THEN 99 ELSE c_nationkey END AS e FROM customer WHERE c_acctbal < 5000)
SELECT r AS record_id, CASE WHEN o.e IS NULL THEN 'new' WHEN n.e IS NULL THEN 'gone' WHEN o.e = n.e THEN 'kept' ELSE 'moved' END AS action FROM o FULL JOIN n USING (r)""",
)
def e_publish_plan(spark, d):
    c = table(spark, d, "customer").withColumn("record_id", F.col("c_custkey"))
    new = F.when(F.col("c_mktsegment") == "BUILDING", 99).otherwise(F.col("c_nationkey"))
    return Y.publish_plan(c.where("c_acctbal > 0").withColumn("entity_id", F.col("c_nationkey")), c.where("c_acctbal < 5000").withColumn("entity_id", new))


@query(
    "t_tfidf_cosine",
    """WITH t AS (SELECT p_partkey AS k, unnest(string_split(lower(p_name), ' ')) AS token FROM part), f AS (SELECT k, token, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM f GROUP BY token),
w AS (SELECT k, token, tf * (ln((1 + (SELECT count(*) FROM part)) / (1 + df)) + 1) AS w FROM f JOIN df USING (token)), u AS (SELECT k, token, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM w),
q AS (SELECT a.p_partkey AS id_l, b.p_partkey AS id_r FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)
SELECT id_l, id_r, round(coalesce(sum(l.w * r.w), 0), 6) AS cosine FROM q LEFT JOIN u l ON l.k = id_l LEFT JOIN u r ON r.k = id_r AND r.token = l.token GROUP BY id_l, id_r""",
)
def t_tfidf_cosine(spark, d):
    w = T.tfidf(table(spark, d, "part"), "p_partkey", "p_name")
    return T.cosine(_part_pairs(spark, d), w, "p_partkey", "id_l", "id_r").withColumn("cosine", F.round("cosine", 6))


SCORES = "r AS (SELECT round(l_quantity / 100, 2) AS s, l_returnflag = 'R' AS y FROM lineitem)"


def _truths(spark, d):
    return table(spark, d, "lineitem").select(F.round(F.col("l_quantity") / 100, 2).alias("s"), (F.col("l_returnflag") == "R").alias("y"))


@query("t_auc_brier", f"WITH {SCORES}, k AS (SELECT s, y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM r) SELECT round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc, round(avg(pow(s - y::INT, 2)), 6) AS brier, count(*) AS n FROM k")
def t_auc_brier(spark, d):
    return T.auc_brier(_truths(spark, d), "s", "y")


@query(
    "t_reliability",
    f"""WITH {SCORES}, g AS (SELECT least(floor(s * 10), 9)::BIGINT AS bin, count(*) AS n, avg(s) AS m, sum(y::INT) AS h FROM r GROUP BY 1), q AS (SELECT *, h / n AS p, 1.96 * 1.96 AS zz FROM g)
SELECT bin, n, round(m, 6) AS mean_score, round(p, 6) AS rate, round((p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n), 6) AS low, round((p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n), 6) AS high FROM q""",
)
def t_reliability(spark, d):
    return T.reliability(_truths(spark, d), "s", "y")


@query("r_usefulness", f"WITH {SCORED} SELECT id_l, id_r, round(0.5 * (1 - abs(2 * match_probability - 1)), 6) AS useful FROM sc")
def r_usefulness(spark, d):
    return _scored(spark, d).select("id_l", "id_r", F.round(0.5 * (1 - F.abs(2 * F.col("match_probability") - 1)), 6).alias("useful"))


@query("r_cluster_queue", f"WITH RECURSIVE {CLUSTERS} SELECT cluster_id, count(*) AS n_units, min(unit_id) AS representative FROM mem GROUP BY cluster_id HAVING count(*) >= 2")
def r_cluster_queue(spark, d):
    return I.queue(_clusters(spark, d), "cluster_id", "unit_id")
