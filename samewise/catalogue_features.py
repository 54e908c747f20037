"""Queries of the feature contract: people and organisations of two kinds, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from samewise.catalogue import query, table
from samewise.catalogue_training import FREQ, _frequencies
from samewise.operators import contract as C
from samewise.operators import features as X
from samewise.operators import training as T

GENDERS = {"MR": "m", "MRS": "f"}

UNITS = """u AS (SELECT p_partkey AS id, p_size AS size, p_size % 6 AS unit_size, p_name AS name, upper(p_name) AS name_core, CASE WHEN p_size % 5 = 0 THEN substr(p_name, 1, 1) ELSE split_part(p_name, ' ', 1) END AS forename, substr(p_name, 1, 2) AS forename_canon,
 split_part(p_name, ' ', 2) AS surname, CASE WHEN p_size % 3 > 0 THEN p_type END AS middle, CASE p_size % 4 WHEN 0 THEN 'MR' WHEN 1 THEN 'MRS' WHEN 2 THEN 'DR' END AS title, CASE WHEN p_size % 2 = 0 THEN p_type || ' ' || p_brand END AS post_nominals,
 CASE WHEN p_size % 7 > 0 THEN 'AB' || p_size % 7 || ' 1CD' END AS postcode, CASE WHEN p_size % 7 > 0 THEN 'AB' || p_size % 7 END AS district, CASE WHEN p_size % 3 = 0 THEN p_brand END AS number, p_type AS legal_form, CASE WHEN p_size > 10 THEN p_size % 2 END AS status,
 CASE WHEN p_size % 11 > 0 THEN 1940 + p_size END AS birth_year, p_size % 12 + 1 AS birth_month, CASE WHEN p_size % 4 > 0 THEN p_size % 4 END AS country, p_size % 25 || ' ' || p_type || ' Street' AS address, CASE WHEN p_size % 5 > 0 THEN DATE '2020-01-01' + p_size END AS notified_on FROM part),
q AS (SELECT l.id AS id_l, r.id AS id_r, l.* EXCLUDE id, COLUMNS(r.*) AS 'r_\\0' FROM u l JOIN u r ON r.id = l.id + l.size),
h AS (SELECT DISTINCT l_partkey AS u, l_orderkey AS c FROM lineitem), sc AS (SELECT id_l, id_r, count(*) AS n FROM q JOIN h a ON a.u = id_l JOIN h b ON b.u = id_r AND b.c = a.c GROUP BY ALL)"""
TFIDF = """tf AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(string_split(lower(name), ' ')) AS token FROM u) GROUP BY ALL), dfq AS (SELECT token, count(*) AS df FROM tf GROUP BY token), wt AS (SELECT id, token, tf * (ln((1 + (SELECT count(*) FROM u)) / (1 + df)) + 1) AS w FROM tf JOIN dfq USING (token)),
nr AS (SELECT id, sqrt(sum(w * w)) AS nrm FROM wt GROUP BY id), cs AS (SELECT id_l, id_r, sum(a.w * b.w / (x.nrm * y.nrm)) AS cosine FROM q JOIN wt a ON a.id = id_l JOIN wt b ON b.id = id_r AND a.token = b.token JOIN nr x ON x.id = id_l JOIN nr y ON y.id = id_r GROUP BY ALL)"""


def _flag(test: str) -> str:
    return f"({test})::INT::DOUBLE"


def _alike(c: str) -> str:
    return f"round(jaro_winkler_similarity({c}, r_{c}), 6)"


def _equal(c: str) -> str:
    return _flag(f"{c} = r_{c}")


def _differs(c: str) -> str:
    return _flag(f"{c} <> r_{c}")


def _units(spark, d):
    size, t = F.col("p_size"), lambda c: c.cast("string")
    w = F.split("p_name", " ")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        size.alias("size"),
        (size % 6).alias("unit_size"),
        F.col("p_name").alias("name"),
        F.upper("p_name").alias("name_core"),
        F.when(size % 5 == 0, F.substring("p_name", 1, 1)).otherwise(w[0]).alias("forename"),
        F.substring("p_name", 1, 2).alias("forename_canon"),
        w[1].alias("surname"),
        F.when(size % 3 > 0, F.col("p_type")).alias("middle"),
        F.when(size % 3 > 0, F.col("p_type")).alias("middle_names"),
        F.when(size % 4 == 0, "MR").when(size % 4 == 1, "MRS").when(size % 4 == 2, "DR").alias("title"),
        F.when(size % 2 == 0, F.concat_ws(" ", "p_type", "p_brand")).alias("post_nominals"),
        F.when(size % 7 > 0, F.concat(F.lit("AB"), t(size % 7), F.lit(" 1CD"))).alias("postcode"),
        F.when(size % 7 > 0, F.concat(F.lit("AB"), t(size % 7))).alias("district"),
        F.when(size % 3 == 0, F.col("p_brand")).alias("number"),
        F.when(size % 3 == 0, F.col("p_brand")).alias("company_number"),
        F.col("p_type").alias("legal_form"),
        F.when(size > 10, size % 2).alias("status"),
        F.when(size % 11 > 0, 1940 + size).alias("birth_year"),
        (size % 12 + 1).alias("birth_month"),
        F.when(size % 4 > 0, size % 4).alias("country"),
        F.when(size % 4 > 0, size % 4).alias("nationality"),
        F.when(size % 4 > 0, size % 4).alias("residence"),
        F.when(size % 4 > 0, size % 4).alias("numeric_suffix"),
        F.when(size > 10, size % 2).alias("subject"),
        F.concat(t(size % 25), F.lit(" "), F.col("p_type"), F.lit(" Street")).alias("address"),
        F.when(size % 5 > 0, F.date_add(F.lit("2020-01-01").cast("date"), size)).alias("notified_on"),
    )


def _unit_pairs(spark, d):
    """Each unit with the one that its size points at: equality joins on the ids."""
    u = _units(spark, d)
    columns = [c for c in u.columns if c != "id"]
    l, r = (u.select(F.col("id").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in "lr")
    return l.withColumn("id_r", F.col("id_l") + F.col("size_l")).join(r, "id_r")


def _held(spark, d, pairs):
    return C.shared_companies(pairs, table(spark, d, "lineitem"), "l_partkey", "l_orderkey")


def _cosined(spark, d, pairs):
    w = T.tfidf(_units(spark, d), "id", "name")
    return pairs.join(T.cosine(pairs, w, "id", "id_l", "id_r").withColumnRenamed("cosine", "core_tfidf"), ["id_l", "id_r"])


def _rounded(df):
    return df.select("id_l", "id_r", *[F.round(c, 6).alias(c) for c in df.columns if c not in ("id_l", "id_r")])


@query(
    "t_donor_person",
    f"""WITH {UNITS}, {FREQ}, g(title, gender) AS (VALUES ('MR', 'm'), ('MRS', 'f'))
SELECT id_l, id_r, {_alike('name')} AS name_similarity, {_flag('q.forename = r_forename')} AS forename_equal, {_flag("(length(q.forename) = 1 OR length(r_forename) = 1) AND substr(q.forename, 1, 1) = substr(r_forename, 1, 1)")} AS forename_initial, {_equal('forename_canon')} AS forename_canon_equal,
 {_flag("substr(middle, 1, 1) = substr(r_middle, 1, 1)")} AS middle_initial_equal, {_flag("substr(middle, 1, 1) <> substr(r_middle, 1, 1)")} AS middle_initial_differs, {_flag("a.gender <> b.gender")} AS gender_differs,
 CASE WHEN post_nominals IS NOT NULL AND r_post_nominals IS NOT NULL THEN {_flag("len(list_intersect(string_split(post_nominals, ' '), string_split(r_post_nominals, ' '))) > 0")} END AS post_nominals_shared, round(log10(1 + greatest(coalesce(sl.n, 0), coalesce(sr.n, 0))), 6) AS surname_log_n, round(log10(1 + greatest(coalesce(fl.n, 0), coalesce(fr.n, 0))), 6) AS full_log_n
FROM q LEFT JOIN g a ON a.title = q.title LEFT JOIN g b ON b.title = r_title LEFT JOIN fq sl ON sl.kind = 'surname' AND sl.surname = q.surname LEFT JOIN fq sr ON sr.kind = 'surname' AND sr.surname = r_surname
 LEFT JOIN fq fl ON fl.kind = 'full' AND fl.surname = q.surname AND fl.forename = q.forename LEFT JOIN fq fr ON fr.kind = 'full' AND fr.surname = r_surname AND fr.forename = r_forename""",
)
def t_donor_person(spark, d):
    pairs = C.with_frequencies(_unit_pairs(spark, d), _frequencies(spark, d))
    return _rounded(C.build(pairs, C.donor_person(GENDERS)))


@query(
    "t_donor_organisation",
    f"""WITH {UNITS}, {TFIDF}, nt AS (SELECT l_partkey AS id, list(DISTINCT l_returnflag) AS ns FROM lineitem GROUP BY 1)
SELECT q.id_l, q.id_r, {_alike('name_core')} AS core_similarity, round(len(list_intersect(string_split(name_core, ' '), string_split(r_name_core, ' '))) / len(list_distinct(list_concat(string_split(name_core, ' '), string_split(r_name_core, ' ')))), 6) AS core_jaccard, round(coalesce(cosine, 0), 6) AS core_tfidf,
 {_equal('postcode')} AS postcode_equal, {_equal('district')} AS district_equal, {_equal('number')} AS number_equal, {_differs('number')} AS number_differs, {_flag('(number IS NULL) <> (r_number IS NULL)')} AS number_one_sided, {_equal('legal_form')} AS form_equal, {_equal('status')} AS status_equal,
 round(len(list_intersect(a.ns, b.ns)) / len(list_distinct(list_concat(a.ns, b.ns))), 6) AS nature_jaccard FROM q LEFT JOIN cs USING (id_l, id_r) LEFT JOIN nt a ON a.id = q.id_l LEFT JOIN nt b ON b.id = q.id_r""",
)
def t_donor_organisation(spark, d):
    pairs = _cosined(spark, d, _unit_pairs(spark, d))
    n = C.natures(table(spark, d, "lineitem"), "l_partkey", "l_returnflag")
    for s in "lr":
        pairs = pairs.join(n.select(F.col("l_partkey").alias(f"id_{s}"), F.col("natures").alias(f"natures_{s}")), f"id_{s}", "left")
    return _rounded(C.build(pairs, C.donor_organisation()))


COMMON = "(sc.n > 0)::INT::DOUBLE AS same_company, sc.n::DOUBLE AS shared_companies, least(unit_size, r_unit_size)::DOUBLE AS size_min, greatest(unit_size, r_unit_size)::DOUBLE AS size_max"


@query(
    "t_controller_person",
    f"""WITH {UNITS}, {FREQ}, rc AS (SELECT DISTINCT a.u, b.u AS t FROM h a JOIN h b ON a.c = b.c AND a.u <> b.u), co AS (SELECT DISTINCT id_l, id_r FROM q JOIN rc a ON a.u = id_l JOIN rc b ON b.u = id_r AND a.t = b.t),
s2 AS (SELECT q.*, coalesce(sc.n, 0) AS n, jaro_winkler_similarity(q.surname, r_surname) >= 1 AS same_s, jaro_winkler_similarity(q.forename, r_forename) >= 1 AS same_f FROM q LEFT JOIN sc USING (id_l, id_r))
SELECT sc.id_l, sc.id_r, {_alike('surname').replace('(surname', '(sc.surname')} AS surname_similarity, {_alike('forename').replace('(forename', '(sc.forename')} AS forename_similarity, {_alike('middle')} AS middle_similarity, {_differs('middle')} AS middle_differs,
 {_flag("list_sort(list_distinct(string_split(upper(sc.forename || ' ' || sc.surname), ' '))) = list_sort(list_distinct(string_split(upper(r_forename || ' ' || r_surname), ' ')))")} AS letters_equal, CASE WHEN same_s THEN round(log10(greatest(1, coalesce(a.n, 1))), 6) END AS surname_log_n, CASE WHEN same_s AND same_f THEN round(log10(greatest(1, coalesce(f.n, 1))), 6) END AS full_log_n,
 {_equal('birth_month')} AS birth_month_equal, abs(birth_year - r_birth_year)::DOUBLE AS birth_year_gap, {_flag('birth_year IS NULL OR r_birth_year IS NULL')} AS birth_missing, {_equal('country')} AS nationality_equal, {_equal('country')} AS residence_equal, {_equal('postcode')} AS postcode_equal, {_equal('district')} AS district_equal, {_alike('address')} AS address_similarity,
 {_flag('co.id_l IS NOT NULL')} AS co_controller, abs(notified_on - r_notified_on)::DOUBLE AS notified_gap, {COMMON}
FROM s2 sc LEFT JOIN co USING (id_l, id_r) LEFT JOIN fq a ON a.kind = 'surname' AND a.surname = sc.surname LEFT JOIN fq f ON f.kind = 'full' AND f.surname = sc.surname AND f.forename = sc.forename""",
)
def t_controller_person(spark, d):
    lines = table(spark, d, "lineitem")
    pairs = _held(spark, d, C.with_frequencies(_unit_pairs(spark, d), _frequencies(spark, d)))
    co = X.co_controlled(pairs.select("id_l", "id_r"), lines, "l_partkey", "l_orderkey")
    return _rounded(C.build(pairs.join(co, ["id_l", "id_r"]), C.controller_person()))


@query(
    "t_controller_organisation",
    f"""WITH {UNITS}, {TFIDF}, s2 AS (SELECT q.*, coalesce(sc.n, 0) AS n FROM q LEFT JOIN sc USING (id_l, id_r))
SELECT sc.id_l, sc.id_r, {_alike('name_core')} AS core_similarity, round(coalesce(cosine, 0), 6) AS core_tfidf, {_flag("list_sort(list_distinct(string_split(name_core, ' '))) = list_sort(list_distinct(string_split(r_name_core, ' ')))")} AS letters_equal, {_equal('number')} AS number_equal, {_differs('number')} AS number_differs,
 {_flag('(number IS NULL) <> (r_number IS NULL)')} AS number_one_sided, {_equal('country')} AS country_equal, {_differs('country')} AS country_differs, {_equal('legal_form')} AS form_equal, {_differs('legal_form')} AS form_differs, {_differs('country')} AS suffix_differs, {_differs('status')} AS subject_differs,
 CASE WHEN jaro_winkler_similarity(name_core, r_name_core) > 0.95 THEN 0.0 END::DOUBLE AS holding_one_sided, {_flag("split_part(address, ' ', 1) <> split_part(r_address, ' ', 1)")} AS house_differs, {_equal('postcode')} AS postcode_equal, {_equal('district')} AS district_equal, {COMMON}
FROM s2 sc LEFT JOIN cs USING (id_l, id_r)""",
)
def t_controller_organisation(spark, d):
    pairs = _held(spark, d, _cosined(spark, d, _unit_pairs(spark, d)))
    return _rounded(C.build(pairs, C.controller_organisation()))


@query("t_nature_sets", "SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS natures FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def t_nature_sets(spark, d):
    kind = F.when(F.col("l_returnflag") == "N", " ").otherwise(F.concat("l_returnflag", "l_linestatus"))
    return C.natures(table(spark, d, "lineitem").withColumn("kind", kind), "l_orderkey", "kind")


@query("t_generic_features", "SELECT l_orderkey AS id_l, l_linenumber AS id_r, l_quantity::DOUBLE AS match_weight, (l_linenumber % 3)::DOUBLE AS gamma_name FROM lineitem")
def t_generic_features(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id_l"), F.col("l_linenumber").alias("id_r"), F.col("l_quantity").alias("match_weight"), (F.col("l_linenumber") % 3).alias("gamma_name"), F.lit(None).cast("int").alias("gamma_never"))
    return C.build(p, C.generic(p))
