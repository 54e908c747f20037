"""Queries over edges, gates and entities, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from samewise.operators import listing as I
from samewise.catalogue import EDGES, _edges, query, table
from samewise.operators import clusters as G
from samewise.operators import entities as E

EDGE_TABLE = f"""{EDGES}, hu AS (SELECT s_suppkey::VARCHAR AS a, (s_suppkey + 1)::VARCHAR AS b, s_suppkey % 3 = 0 AS same FROM supplier), st AS (SELECT min(s_suppkey::VARCHAR) OVER (PARTITION BY s_nationkey) AS a, s_suppkey::VARCHAR AS b FROM supplier),
al AS (SELECT src::VARCHAR AS a, dst::VARCHAR AS b, 0 AS o, 'score' AS source FROM ed UNION ALL SELECT a, b, 1, 'human' FROM hu WHERE same UNION ALL SELECT a, b, 2, 'import' FROM st WHERE a <> b),
et AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, min_by(source, o) AS source FROM al GROUP BY 1, 2), eg AS (SELECT et.* FROM et ANTI JOIN (SELECT least(a, b) AS src, greatest(a, b) AS dst FROM hu WHERE NOT same) n USING (src, dst))"""


def _edge_table(spark, d):
    s = table(spark, d, "supplier").withColumn("id", F.col("s_suppkey").cast("string"))
    accepted = _edges(spark, d).select(F.col("src").alias("id_l"), F.col("dst").alias("id_r"))
    human = s.select(F.col("s_suppkey").alias("id_l"), (F.col("s_suppkey") + 1).alias("id_r"), (F.col("s_suppkey") % 3 == 0).alias("same"))
    return E.edge_table(accepted, human, G.import_stars(s, "id", "s_nationkey"))


@query("g_edge_table", f"WITH {EDGE_TABLE} SELECT * FROM eg")
def g_edge_table(spark, d):
    return _edge_table(spark, d)


MEMBERS = "gm AS (SELECT c_custkey AS unit_id, 'C-' || c_nationkey || c_mktsegment AS cluster_id, c_custkey % 2 AS track, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 40 END AS existing_id, floor(c_acctbal / 4000)::BIGINT AS band FROM customer)"
GATE = f"""{MEMBERS}, per AS (SELECT cluster_id, count(*) AS n_units, count(DISTINCT existing_id) AS ids, count(DISTINCT band) AS bands FROM gm GROUP BY 1),
wk AS (SELECT a.cluster_id, min(a.unit_id % 10 / 10) AS weakest FROM gm a JOIN gm b ON b.unit_id = a.unit_id + 1 AND a.cluster_id = b.cluster_id GROUP BY 1),
cf AS (SELECT DISTINCT a.cluster_id FROM gm a JOIN gm b ON b.unit_id = a.unit_id + 3 AND a.cluster_id = b.cluster_id WHERE a.unit_id % 4 = 0),
cr AS (SELECT DISTINCT cluster_id FROM gm WHERE existing_id IN (SELECT existing_id FROM gm GROUP BY 1 HAVING count(DISTINCT track) > 1)),
fl AS (SELECT cluster_id, n_units, cluster_id LIKE 'C-1%' AS h, n_units >= 2 AND cluster_id IN (FROM cf) AS f1, n_units >= 2 AND n_units > 5 AND NOT h AS f2, n_units >= 2 AND bands > 2 AND NOT h AS f3, coalesce(n_units >= 2 AND weakest < 0.2 AND NOT h, false) AS f4, n_units >= 2 AND ids > 1 AND NOT h AS f5, n_units >= 2 AND cluster_id IN (FROM cr) AS f6 FROM per LEFT JOIN wk USING (cluster_id)),
gt AS (SELECT cluster_id, n_units, concat_ws('|', CASE WHEN f1 THEN 'conflict' END, CASE WHEN f2 THEN 'too_large' END, CASE WHEN f3 THEN 'mixed_names' END, CASE WHEN f4 THEN 'weak_link' END, CASE WHEN f5 THEN 'mixed_ids' END, CASE WHEN f6 THEN 'cross_track_ids' END) AS statuses FROM fl)"""


def _full_gate(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    members = c.select(k.alias("unit_id"), F.concat(F.lit("C-"), F.col("c_nationkey").cast("string"), "c_mktsegment").alias("cluster_id"), (k % 2).alias("track"), F.when(k % 3 == 0, k % 40).alias("existing_id"), F.floor(F.col("c_acctbal") / 4000).alias("band"))
    pairs = c.select(k.alias("id_l"), (k + 1).alias("id_r"), (k % 10 / 10).alias("p"))
    human = c.select(k.alias("id_l"), (k + 3).alias("id_r"), (k % 4 != 0).alias("same"))
    merged = members.where("cluster_id LIKE 'C-1%'").select("cluster_id")
    return E.full_gate(members, pairs, human, names=[["band"]], limit=2, max_units=5, merged=merged)


@query("g_full_gate", f"WITH {GATE} SELECT cluster_id, n_units, CASE WHEN statuses = '' THEN 'ok' ELSE string_split(statuses, '|')[1] END AS status, statuses, statuses <> '' AS withheld FROM gt")
def g_full_gate(spark, d):
    return _full_gate(spark, d)


@query("g_cluster_counts", f"WITH {GATE} SELECT CASE WHEN statuses = '' THEN 'ok' ELSE string_split(statuses, '|')[1] END AS status, count(*) AS n, sum(n_units)::BIGINT AS units FROM gt GROUP BY 1")
def g_cluster_counts(spark, d):
    return I.by_kind(_full_gate(spark, d), "status", {"units": "n_units"})


REBUILT = f"""{EDGE_TABLE}, mw AS (SELECT s_suppkey::VARCHAR AS unit_id, 'C-' || (s_nationkey // 5) AS cluster_id, (s_nationkey // 5) % 2 = 0 AS withheld FROM supplier),
sg AS (SELECT src, dst FROM eg WHERE source <> 'score' AND src IN (SELECT unit_id FROM mw WHERE withheld) AND dst IN (SELECT unit_id FROM mw WHERE withheld)), bw AS (SELECT src AS a, dst AS b FROM sg UNION SELECT dst, src FROM sg),
rc AS (SELECT a AS node, b AS other FROM bw UNION SELECT r.node, w.b FROM rc r JOIN bw w ON r.other = w.a), cp AS (SELECT node, least(min(other), node) AS component FROM rc GROUP BY node),
pt AS (SELECT unit_id, CASE WHEN withheld THEN 'C-' || coalesce(component, unit_id) ELSE cluster_id END AS part FROM mw LEFT JOIN cp ON node = unit_id)"""


def _parts(spark, d):
    five = F.expr("s_nationkey div 5")
    m = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("unit_id"), F.concat(F.lit("C-"), five.cast("string")).alias("cluster_id"), (five % 2 == 0).alias("withheld"))
    return E.rebuild_withheld(m.drop("withheld"), m.select("cluster_id", "withheld").distinct(), _edge_table(spark, d))


@query("g_withheld_rebuild", f"WITH RECURSIVE {REBUILT} SELECT unit_id, part FROM pt")
def g_withheld_rebuild(spark, d):
    return _parts(spark, d)


RANK_SQL = "CASE source WHEN 'score' THEN 2 WHEN 'import' THEN 4 WHEN 'human' THEN 5 WHEN 'exact_key' THEN 1 ELSE 0 END"


@query("g_part_source", f"WITH RECURSIVE {REBUILT} SELECT a.part, max_by(source, {RANK_SQL}) AS source FROM eg JOIN pt a ON a.unit_id = src JOIN pt b ON b.unit_id = dst WHERE a.part = b.part GROUP BY 1")
def g_part_source(spark, d):
    return E.part_source(_parts(spark, d), _edge_table(spark, d))


@query("g_held_queue", "SELECT o_custkey AS group_id, min(o_orderstatus) AS track, count(*) AS n_records FROM orders GROUP BY 1 HAVING count(*) > 15")
def g_held_queue(spark, d):
    return I.held_queue(table(spark, d, "orders").withColumnRenamed("o_custkey", "group_id"), "group_id", "o_orderstatus", 15)


# ------------------------------------------------------------ entities

RECORDS_SQL = "rr AS (SELECT p_partkey AS record_id, p_size * 100 + p_partkey % 2 AS unit_id, p_size AS entity_key FROM part)"


@query("e_proposed_basis", f"WITH {RECORDS_SQL}, k AS (SELECT entity_key, count(*) AS n, count(DISTINCT unit_id) AS u FROM rr GROUP BY 1) SELECT record_id, unit_id, entity_key, CASE WHEN n = 1 THEN 'single' WHEN u = 1 THEN 'exact_key' WHEN entity_key % 2 = 0 THEN 'import' ELSE 'score' END AS basis FROM rr JOIN k USING (entity_key)")
def e_proposed_basis(spark, d):
    size = F.col("p_size").cast("long")
    r = table(spark, d, "part").select(F.col("p_partkey").alias("record_id"), (size * 100 + F.col("p_partkey") % 2).alias("unit_id"), F.col("p_size").alias("entity_key"))
    src = r.where("entity_key % 2 = 0").select(F.col("entity_key").alias("part"), F.lit("import").alias("source")).distinct()
    return E.proposed(r, src)


RESOLVE = """mm AS (SELECT c_custkey AS record_id, 'K' || (c_custkey // 3) AS entity_key FROM customer), rg AS (SELECT c_custkey AS record_id, 'E' || (c_custkey // 5) AS claim FROM customer WHERE c_acctbal > 3000),
cl AS (SELECT DISTINCT entity_key, claim FROM mm JOIN rg USING (record_id)), bs AS (SELECT entity_key, min(claim) AS survivor, count(*) AS n FROM cl GROUP BY 1)"""


def _resolved(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    members = c.select(k.alias("record_id"), F.concat(F.lit("K"), F.expr("c_custkey div 3").cast("string")).alias("entity_key"))
    registry = c.where("c_acctbal > 3000").select(k.alias("record_id"), F.concat(F.lit("E"), F.expr("c_custkey div 5").cast("string")).alias("entity_id"))
    minted = members.select("entity_key", F.concat(F.lit("M"), "entity_key").alias("entity_id")).distinct()
    return E.resolve_ids(members, registry, minted)


@query("e_id_resolution", f"WITH {RESOLVE} SELECT DISTINCT entity_key, coalesce(survivor, 'M' || entity_key) AS entity_id, CASE WHEN n = 1 THEN 'kept' WHEN n > 1 THEN 'merged' ELSE 'minted' END AS id_status FROM mm LEFT JOIN bs USING (entity_key)")
def e_id_resolution(spark, d):
    return _resolved(spark, d)[0]


@query("e_absorbed_ids", f"WITH {RESOLVE} SELECT DISTINCT claim AS absorbed, survivor FROM cl JOIN bs USING (entity_key) WHERE claim <> survivor")
def e_absorbed_ids(spark, d):
    return _resolved(spark, d)[1]


@query(
    "e_id_collisions",
    """WITH i AS (SELECT c_custkey AS entity_key, 'E' || (c_custkey % 97) AS entity_id, c_custkey % 5 = 0 AS reg, c_custkey % 11 AS n, 'R' || lpad(c_custkey::VARCHAR, 8, '0') AS small FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY reg DESC, CASE WHEN reg THEN 0 ELSE -n END, small) AS r FROM i)
SELECT entity_key, CASE WHEN r = 1 THEN entity_id ELSE small END AS entity_id, CASE WHEN r = 1 THEN 'minted' ELSE 'minted_after_collision' END AS id_status FROM r""",
)
def e_id_collisions(spark, d):
    k = F.col("c_custkey")
    small = F.concat(F.lit("R"), F.lpad(k.cast("string"), 8, "0"))
    return E.break_collisions(table(spark, d, "customer").select(k.alias("entity_key"), F.concat(F.lit("E"), (k % 97).cast("string")).alias("entity_id"), F.lit("minted").alias("id_status"), (k % 5 == 0).alias("from_registry"), (k % 11).alias("n_records"), small.alias("smallest_record")))


@query("e_mint_agreed", "SELECT o_custkey, CASE WHEN count(DISTINCT CASE WHEN o_orderpriority SIMILAR TO '[1-3].*' THEN o_orderpriority END) = 1 THEN min(CASE WHEN o_orderpriority SIMILAR TO '[1-3].*' THEN o_orderpriority END) END AS agreed FROM orders GROUP BY 1")
def e_mint_agreed(spark, d):
    return E.mint_agreed(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "^[1-3]")


@query("e_number_order", "SELECT o_custkey, min_by(id, (k, t)) AS first_id FROM (SELECT o_custkey, o_orderkey AS k, o_orderstatus = 'F' AS t, CASE WHEN o_orderstatus = 'F' THEN 'TR' ELSE '' END || o_orderkey AS id FROM orders) GROUP BY 1")
def e_number_order(spark, d):
    t = F.col("o_orderkey").cast("string")
    rows = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("TR"), t)).otherwise(t).alias("id"))
    return rows.groupBy("o_custkey").agg(F.min(E.number_order(F.col("id")))["id"].alias("first_id"))


@query(
    "e_vote_tally",
    "WITH v AS (SELECT o_custkey, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, value) AS r, count(*) OVER (PARTITION BY o_custkey) AS k FROM v) SELECT o_custkey, '[' || string_agg('{\"value\":\"' || value || '\",\"n\":' || n || '}', ',' ORDER BY r) || ']' AS votes FROM r WHERE k > 1 AND r <= 3 GROUP BY 1",
)
def e_vote_tally(spark, d):
    return E.vote_tally(table(spark, d, "orders"), "o_custkey", "o_orderpriority", 3)


@query("e_invariants", "WITH e AS (SELECT l_orderkey AS record_id, CASE WHEN l_linenumber < 6 THEN l_partkey END AS entity_id, l_returnflag AS track FROM lineitem) SELECT count(*) FILTER (entity_id IS NULL) AS missing, (SELECT count(*) FROM (SELECT 1 FROM e GROUP BY record_id HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM (SELECT 1 FROM e GROUP BY entity_id HAVING count(DISTINCT track) > 1)) AS crossed FROM e")
def e_invariants(spark, d):
    return E.invariants(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.when(F.col("l_linenumber") < 6, F.col("l_partkey")).alias("entity_id"), F.col("l_returnflag").alias("track")))


PLAN = "o AS (SELECT c_custkey AS r, 'E' || (c_custkey // 4) AS e FROM customer WHERE c_acctbal > 0), n AS (SELECT c_custkey AS r, 'E' || (c_custkey // 3) AS e FROM customer WHERE c_acctbal < 7000), j AS (SELECT o.e AS old, n.e AS new FROM o FULL JOIN n USING (r))"


@query(
    "e_publish_kinds",
    f"WITH {PLAN} SELECT new AS entity_id, CASE WHEN count(DISTINCT old) = 0 THEN 'new' WHEN count(DISTINCT old) > 1 THEN 'merged' ELSE 'kept' END AS kind FROM j WHERE new IS NOT NULL GROUP BY 1 UNION ALL SELECT old, CASE WHEN count(DISTINCT new) = 0 THEN 'gone' ELSE 'split' END FROM j WHERE old IS NOT NULL GROUP BY 1 HAVING count(DISTINCT new) <> 1",
)
def e_publish_kinds(spark, d):
    c = table(spark, d, "customer").withColumn("record_id", F.col("c_custkey"))
    by = lambda n: F.concat(F.lit("E"), F.expr(f"c_custkey div {n}").cast("string"))
    return E.plan_kinds(c.where("c_acctbal > 0").withColumn("entity_id", by(4)), c.where("c_acctbal < 7000").withColumn("entity_id", by(3)))


PROVENANCE = """gr AS (SELECT c_custkey::VARCHAR AS record_id, c_nationkey AS group_id FROM customer WHERE c_mktsegment = 'BUILDING'), en AS (SELECT c_custkey::VARCHAR AS record_id, c_nationkey % 7 AS entity_id FROM customer),
ev AS (SELECT min(record_id) OVER (PARTITION BY group_id) AS record_a, record_id AS record_b, 'exact_key' AS source FROM gr UNION ALL SELECT c_custkey::VARCHAR, (c_custkey + 7)::VARCHAR, CASE WHEN c_custkey % 2 = 0 THEN 'score' ELSE 'human' END FROM customer),
pv AS (SELECT a.entity_id, record_a, record_b, source FROM ev JOIN en a ON a.record_id = record_a JOIN en b ON b.record_id = record_b WHERE a.entity_id = b.entity_id AND record_a <> record_b)"""


def _provenance(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    groups = c.where("c_mktsegment = 'BUILDING'").select(k.cast("string").alias("record_id"), F.col("c_nationkey").alias("group_id"))
    accepted = c.select(k.cast("string").alias("record_a"), (k + 7).cast("string").alias("record_b"), F.when(k % 2 == 0, "score").otherwise("human").alias("source"))
    return E.provenance(groups, accepted, c.select(k.cast("string").alias("record_id"), (F.col("c_nationkey") % 7).alias("entity_id")))


@query("e_provenance_edges", f"WITH {PROVENANCE} SELECT * FROM pv")
def e_provenance_edges(spark, d):
    return _provenance(spark, d)


@query("e_provenance_chain", f"WITH {PROVENANCE}, k AS (SELECT entity_id, source, count(*) AS n FROM pv GROUP BY ALL) SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY {RANK_SQL}) AS step, source, n FROM k")
def e_provenance_chain(spark, d):
    return E.provenance_chain(_provenance(spark, d))


@query(
    "m_human_split",
    """WITH RECURSIVE gr AS (SELECT c_custkey::VARCHAR AS record_id, 'X-' || c_nationkey AS group_id FROM customer), lb AS (SELECT c_custkey::VARCHAR AS record_a, (c_custkey + 25)::VARCHAR AS record_b, c_custkey % 3 > 0 AS same FROM customer),
ins AS (SELECT record_a, record_b, same, a.group_id FROM lb JOIN gr a ON a.record_id = record_a JOIN gr b ON b.record_id = record_b WHERE a.group_id = b.group_id), sp AS (SELECT group_id FROM ins GROUP BY 1 HAVING bool_or(same) AND bool_or(NOT same)),
ed AS (SELECT record_a AS a, record_b AS b FROM ins WHERE same AND group_id IN (FROM sp)), bw AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), rc AS (SELECT a AS node, b AS other FROM bw UNION SELECT r.node, w.b FROM rc r JOIN bw w ON r.other = w.a), cc AS (SELECT node, least(min(other), node) AS component FROM rc GROUP BY node)
SELECT record_id, CASE WHEN s.group_id IS NOT NULL THEN 'X-' || component ELSE gr.group_id END AS group_id, s.group_id IS NOT NULL AS split FROM gr LEFT JOIN sp s ON s.group_id = gr.group_id LEFT JOIN cc ON node = record_id""",
)
def m_human_split(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    groups = c.select(k.cast("string").alias("record_id"), F.concat(F.lit("X-"), F.col("c_nationkey").cast("string")).alias("group_id"))
    return E.dissolve(groups, c.select(k.cast("string").alias("record_a"), (k + 25).cast("string").alias("record_b"), (k % 3 > 0).alias("same")))


@query("r_entities_list", "SELECT c_nationkey AS entity_id, count(*) AS n_records, string_agg(DISTINCT c_mktsegment, ' | ' ORDER BY c_mktsegment) AS segments, max(c_acctbal) AS largest FROM customer GROUP BY 1 ORDER BY n_records DESC, entity_id LIMIT 10")
def r_entities_list(spark, d):
    per = I.entities(table(spark, d, "customer").withColumnRenamed("c_nationkey", "entity_id"), "entity_id", {"segments": "c_mktsegment"}, "c_acctbal")
    return I.page(per, [F.desc("n_records"), "entity_id"], 0, 10)


@query("e_override_latest", "SELECT user_id, max_by(event_type, event_id) AS value, max(event_id) AS override_id, count(*) - 1 AS superseded FROM events GROUP BY 1")
def e_override_latest(spark, d):
    return I.latest_override(table(spark, d, "events"), "user_id", "event_type", "event_id")
