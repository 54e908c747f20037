"""Queries over loading, cleaning, functions, conditions and exports, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from samewise.sources import exports as K
from samewise.operators import loading as N
from samewise.catalogue import query, table
from samewise.functions import text as X
from samewise.operators import conditions as P


# ------------------------------------------------------------ loading

@query("l_drop_flags", "SELECT count(*) AS total, count(*) FILTER (event_type LIKE 'c%') AS dropped_kind, count(*) FILTER (props IS NULL OR trim(props) = '') AS dropped_blank FROM events")
def l_drop_flags(spark, d):
    return N.drop_counts(table(spark, d, "events"), {"kind": F.col("event_type").startswith("c"), "blank": X.blank_to_null(F.col("props")).isNull()})


@query("l_id_text", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 = 1 THEN p_partkey || '.5' ELSE p_partkey::VARCHAR END AS id FROM part")
def l_id_text(spark, d):
    k = F.col("p_partkey")
    t = k.cast("string")
    raw = F.when(k % 7 == 0, " NaN ").when(k % 7 == 1, F.concat(t, F.lit(".5"))).when(k % 7 == 2, F.concat(F.lit("\t"), t, F.lit(".0"))).otherwise(t)
    return table(spark, d, "part").select("p_partkey", X.id_text(raw).alias("id"))


@query("l_namespaced_id", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'TR' ELSE '' END || c_custkey AS record_id FROM customer")
def l_namespaced_id(spark, d):
    return table(spark, d, "customer").select("c_custkey", N.namespaced_id(F.col("c_custkey"), F.col("c_mktsegment"), {"building": "TR"}).alias("record_id")).where("record_id IS NOT NULL")


@query("l_review_state", "SELECT o_orderkey, CASE WHEN o_custkey % 10 IN (0, 1) THEN 'unlabelled' ELSE 'labelled' END AS review_state FROM orders")
def l_review_state(spark, d):
    k = F.col("o_custkey") % 10
    earlier = F.when(k == 0, "0.0").when(k == 1, "TR0").otherwise(k.cast("string"))
    return table(spark, d, "orders").select("o_orderkey", N.review_state(earlier).alias("review_state"))


@query("l_truthiness", "SELECT p_partkey, p_size % 4 < 2 AS flag FROM part")
def l_truthiness(spark, d):
    k = F.col("p_size") % 4
    return table(spark, d, "part").select("p_partkey", X.is_true(F.when(k == 0, " Yes ").when(k == 1, "1").when(k == 2, "no")).alias("flag"))


@query("l_event_projection", "SELECT user_id, event_id, ts::DATE AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS position FROM events")
def l_event_projection(spark, d):
    return N.event_projection(table(spark, d, "events"), "user_id", {"day": F.to_date("ts")}, "ts", "event_id")


@query("l_duplicate_ids", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 3")
def l_duplicate_ids(spark, d):
    return N.repeated_ids(table(spark, d, "lineitem"), "l_orderkey")


# ------------------------------------------------------------ functions and steps

@query("f_person_name", "WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, CASE WHEN len(w) > 1 THEN w[1] END AS forename, nullif(array_to_string(w[2:len(w) - 1], ' '), '') AS middle_names, w[-1] AS surname, CASE WHEN len(w) > 1 THEN w[1][1] END AS forename_initial FROM w")
def f_person_name(spark, d):
    return table(spark, d, "part").select("p_partkey", X.person_name(F.col("p_name")).alias("n")).select("p_partkey", "n.*")


@query("f_postcode", "WITH c AS (SELECT p_partkey, 'sw' || (p_partkey % 10) || 'a-' || (p_size % 10) || 'xy' AS raw FROM part) SELECT p_partkey, upper(regexp_replace(raw, '-', ' ')) AS code, upper(string_split(raw, '-')[1]) AS district FROM c")
def f_postcode(spark, d):
    raw = F.concat(F.lit("sw"), (F.col("p_partkey") % 10).cast("string"), F.lit("a-"), (F.col("p_size") % 10).cast("string"), F.lit("xy"))
    return table(spark, d, "part").select("p_partkey", X.postcode(raw).alias("code"), X.postcode_district(X.postcode(raw)).alias("district"))


@query("f_name_fingerprint", "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(upper(p_name), ' '))), '') AS value FROM part")
def f_name_fingerprint(spark, d):
    return table(spark, d, "part").select("p_partkey", X.fingerprint(F.concat("p_name", F.lit("."))).alias("value"))


@query("f_house_number", "SELECT p_partkey, p_size || 'B' AS number FROM part")
def f_house_number(spark, d):
    return table(spark, d, "part").select("p_partkey", X.house_number(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("b High Street 4"))).alias("number"))


@query("f_money_text", "SELECT p_partkey, regexp_replace(format('{:,.2f}', p_retailprice), '\\.00$', '') AS money FROM part")
def f_money_text(spark, d):
    return table(spark, d, "part").select("p_partkey", X.money_text(F.col("p_retailprice")).alias("money"))


@query("f_key_text", "SELECT p_partkey, p_size::VARCHAR AS size, upper(p_type) AS kind FROM part")
def f_key_text(spark, d):
    return table(spark, d, "part").select("p_partkey", X.key_text(F.col("p_size").cast("double")).alias("size"), X.key_text(F.concat(F.lit("  "), "p_type")).alias("kind"))


@query("f_metaphone")
def f_metaphone(spark, d):
    return table(spark, d, "part").select("p_partkey", X.metaphone(F.col("p_name")).alias("sound"))


@query("c_lookup_words", "SELECT p_partkey, nullif(array_to_string(list_filter(list_transform(string_split(p_type || ' ' || p_name, ' '), lambda w: CASE upper(w) WHEN 'STEEL' THEN 'iron' WHEN 'TIN' THEN NULL ELSE w END), lambda w: w IS NOT NULL), ' '), '') AS value FROM part")
def c_lookup_words(spark, d):
    return table(spark, d, "part").select("p_partkey", X.lookup_words(F.concat_ws(" ", "p_type", "p_name"), {"steel": "iron", "Tin": None}).alias("value"))


@query(
    "c_strip_and_keep",
    "WITH w AS (SELECT p_partkey, string_split(p_type || ' ' || p_brand, ' ') AS w FROM part) SELECT p_partkey, CASE WHEN upper(w[1]) IN ('STANDARD', 'SMALL', 'ECONOMY') THEN array_to_string(w[2:], ' ') ELSE array_to_string(w, ' ') END AS rest, CASE WHEN upper(w[1]) IN ('STANDARD', 'SMALL', 'ECONOMY') THEN w[1] END AS removed FROM w",
)
def c_strip_and_keep(spark, d):
    return table(spark, d, "part").select("p_partkey", X.strip_and_keep(F.concat_ws(" ", "p_type", "p_brand"), ["standard", "Small", "economy"], repeat=False).alias("x")).select("p_partkey", "x.*")


@query("c_years_ago", "SELECT p_partkey, CASE WHEN 1990 + p_size <= year(current_date) - 16 AND p_size >= 5 THEN 1990 + p_size END AS birth_year FROM part")
def c_years_ago(spark, d):
    return table(spark, d, "part").select("p_partkey", X.not_after_years_ago(F.col("p_size") + 1990, 16, 1995).alias("birth_year"))


@query("c_step_trace", "SELECT p_partkey, p_type AS before, upper(p_type) AS after, true AS changed, string_split(upper(p_type), ' ')[1] AS first FROM part")
def c_step_trace(spark, d):
    steps = [{"source": "p_type", "target": "kind", "op": "upper"}, {"source": "kind", "target": "kind", "op": "first_token"}]
    return P.trace(table(spark, d, "part"), steps, ["p_partkey"]).select("p_partkey", "step0.*", F.col("step1.after").alias("first"))


# ------------------------------------------------------------ conditions and filters

def _token_query(name, op, values, sql):
    def run(spark, d):
        df = table(spark, d, "part").withColumn("t", F.concat("p_type", F.when(F.col("p_partkey") % 2 == 0, F.lit(" (tin).")).otherwise(F.lit(""))))
        return df.select("p_partkey", P.condition(df, {"column": "t", "op": op, "values": values}).alias("holds"))

    query(name, f"SELECT p_partkey, {sql} AS holds FROM (SELECT p_partkey, upper(p_type) || CASE WHEN p_partkey % 2 = 0 THEN ' (TIN).' ELSE '' END AS t FROM part)")(run)


_token_query("p_starts_with_token", "starts_with_token", ["standard", "small plated"], "regexp_matches(t, '^(STANDARD|SMALL\\s+PLATED)([^0-9A-Z]|$)')")
_token_query("p_ends_with_token", "ends_with_token", ["tin)", "brass"], "regexp_matches(t, '(TIN\\)|(^|[^0-9A-Z])BRASS)[.,\\s]*$')")
_token_query("p_contains_phrase", "contains_token", ["tin", "polished brass"], "regexp_matches(t, '(^|[^0-9A-Z])(TIN|POLISHED\\s+BRASS)([^0-9A-Z]|$)')")


@query("p_rule_hits", "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_nationkey < 5 THEN 1 ELSE -1 END AS track_rule, CASE WHEN c_mktsegment = 'BUILDING' OR c_nationkey < 5 THEN 'organisation' ELSE 'person' END AS track, count(*) AS n FROM customer GROUP BY ALL")
def p_rule_hits(spark, d):
    rules = [{"track": "organisation", "when": [{"column": "c_mktsegment", "op": "equals", "value": "building"}]}, {"track": "organisation", "when": [{"column": "c_nationkey", "op": "in", "values": [0, 1, 2, 3, 4]}]}]
    return P.rule_hits(P.assign_tracks(table(spark, d, "customer"), rules, "person"))


@query("p_focus_pick", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_linestatus <> 'O' THEN 'closed' ELSE 'open' END AS focus FROM lineitem")
def p_focus_pick(spark, d):
    df = table(spark, d, "lineitem")
    rules = [{"focus": "returned", "when": [{"column": "l_returnflag", "op": "equals", "value": "r"}]}, {"focus": "closed", "when": [{"column": "l_linestatus", "op": "not_equals", "value": "o"}]}]
    return df.select("l_orderkey", "l_linenumber", P.first_match(df, rules, F.lit("open"), "focus").alias("focus"))


@query("p_label_filters", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_linestatus LIKE '%F%'")
def p_label_filters(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag IN ('A', 'R') AND l_shipdate >= timestamp_ntz'1995-01-01' AND l_shipdate < timestamp_ntz'1997-01-01' AND l_linestatus LIKE '%F%'").select("l_orderkey", "l_linenumber")


@query("p_key_filter", "SELECT c_custkey FROM customer WHERE '|' || CASE WHEN c_nationkey % 2 = 0 THEN 'name|post' ELSE 'names' END || '|' LIKE '%|name|%'")
def p_key_filter(spark, d):
    keys = F.when(F.col("c_nationkey") % 2 == 0, "name|post").otherwise("names")
    return table(spark, d, "customer").where(F.array_contains(F.split(keys, "[|]"), "name")).select("c_custkey")


# ------------------------------------------------------------ exports

@query(
    "k_bulk_lines",
    "SELECT c_custkey AS k, 1 AS part, '{\"index\":{\"_id\":\"' || c_custkey || '\"}}' AS line FROM customer WHERE c_nationkey > 4 UNION ALL SELECT c_custkey, 2, '{\"record_id\":\"' || c_custkey || '\",\"entity_id\":\"E' || c_nationkey || '\"}' FROM customer WHERE c_nationkey > 4",
)
def k_bulk_lines(spark, d):
    entity = F.when(F.col("c_nationkey") > 4, F.concat(F.lit("E"), F.col("c_nationkey").cast("string")))
    return K.bulk_lines(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), entity.alias("e")), "k", "e")


@query("k_export_rows", "SELECT c_custkey, c_name, c_mktsegment, 'E' || s_nationkey AS entity_id, CASE WHEN s_nationkey IS NULL THEN 'none' ELSE 'matched' END AS basis FROM customer LEFT JOIN (SELECT DISTINCT s_nationkey FROM supplier) ON s_nationkey = c_nationkey")
def k_export_rows(spark, d):
    e = table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.concat(F.lit("E"), F.col("s_nationkey").cast("string")).alias("entity_id"))
    return K.with_entities(table(spark, d, "customer"), e, "c_nationkey").select("c_custkey", "c_name", "c_mktsegment", "entity_id", "basis")
