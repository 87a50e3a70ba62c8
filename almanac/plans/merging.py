"""Queries of snapshot merging, entity resolution and geocoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audits, build, geo, match, merge, resolve
from .registry import query, table
from .text import _slug

# ---- merge ----


def _snapshots(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"), F.lit("2026-01-01").cast("date").alias("last_seen"), (F.col("o_orderkey") % 20 == 0).alias("stale"))
    return o.where("id % 10 <> 7"), o.where("id % 10 <> 3")  # current, previous


@query("op_e2_enrich_aliases", "SELECT s_suppkey, CASE WHEN s_nationkey % 3 <> 0 THEN s_nationkey::VARCHAR END AS kommune_nr, CASE WHEN s_nationkey % 2 = 0 THEN n_name ELSE 'old' END AS fylke_now FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def aliases(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey").cast("string")).alias("kommune_nr"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("fylke_now"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"), F.lit("old").alias("fylke_now"))
    return merge.enrich(s, n, "n_nationkey", ["kommune_nr", "fylke_now"]).select("s_suppkey", "kommune_nr", "fylke_now")


@query("op_e3_enrich_geocache", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey / 10 END AS lat, CASE WHEN s_suppkey % 3 = 0 THEN 'osm' END AS geo_source FROM supplier")
def geocache(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    cache = s.where("s_suppkey % 3 = 0").select("s_suppkey", (F.col("s_suppkey") / 10).alias("lat"), F.lit("osm").alias("geo_source"))
    return merge.enrich(s, cache, "s_suppkey", ["lat", "geo_source"])


@query("op_e4_apply_overrides", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 1 THEN 'patched' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 4 <> 1 AND s_suppkey % 4 <> 2 THEN s_acctbal END AS s_acctbal FROM supplier")
def overrides(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    fields = F.when(F.col("s_suppkey") % 4 == 1, F.array(F.lit("s_name"), F.lit("s_acctbal"))).when(F.col("s_suppkey") % 4 == 2, F.array(F.lit("s_acctbal"))).otherwise(F.array().cast("array<string>"))
    patch = s.where("s_suppkey % 4 > 0").select("s_suppkey", F.lit("patched").alias("s_name"), F.lit(None).cast("double").alias("s_acctbal"), fields.alias("set_fields"))
    return merge.apply_overrides(s, patch, "s_suppkey").select("s_suppkey", "s_name", "s_acctbal")


@query("op_e5_soft_delete", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 7 THEN DATE '2026-01-01' ELSE DATE '2026-07-28' END AS last_seen, o_orderkey % 10 = 7 AS stale FROM orders")
def soft_delete(spark, sf_dir):
    cur, prev = _snapshots(spark, sf_dir)
    return merge.soft_delete(cur, prev, "id", "2026-07-28").select("id", "last_seen", "stale")


@query("op_e6_h2_changed_ids", """
SELECT o_orderkey AS id, 'new' AS kind FROM orders WHERE o_orderkey % 10 <> 7 AND (o_orderkey % 10 = 3 OR o_orderkey % 20 = 0) UNION ALL SELECT o_orderkey, 'removed' FROM orders WHERE o_orderkey % 10 = 7
UNION ALL SELECT o_orderkey, 'changed' FROM orders WHERE o_orderkey % 10 IN (3, 7) OR o_orderkey % 20 = 0""")  # fmt: skip
def changes(spark, sf_dir):
    cur, prev = _snapshots(spark, sf_dir)
    kinds = {"new": merge.new_ids(cur, prev, "id"), "removed": merge.removed_ids(cur, prev, "id"), "changed": merge.changed_ids(cur, prev, "id")}
    a, b, c = (d.withColumn("kind", F.lit(k)) for k, d in kinds.items())
    return a.unionByName(b).unionByName(c)


_REPORT = """
WITH c AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 7), p AS (SELECT o_orderkey AS k, o_orderkey % 20 = 0 AS stale FROM orders WHERE o_orderkey % 10 <> 3),
n AS (SELECT k FROM c WHERE k NOT IN (SELECT k FROM p WHERE NOT stale)), r AS (SELECT k FROM p WHERE k NOT IN (SELECT k FROM c)),
t AS (SELECT (SELECT count(*) FROM c) AS n_current, (SELECT count(*) FROM p WHERE NOT stale) AS n_previous_live, (SELECT count(*) FROM r) AS n_stale, (SELECT count(*) FROM n) AS n_new, (SELECT count(*) FROM r) AS n_removed,
  (SELECT count(*) FROM (FROM n UNION FROM r)) AS ch)"""


@query("op_f8_build_report", _REPORT + " SELECT n_current, n_previous_live, n_stale, n_new, n_removed, round(ch / greatest(n_current, n_previous_live), 6) AS churn, (SELECT count(*) FROM supplier) AS n_venues, (SELECT count(*) FROM supplier WHERE s_suppkey % 9 = 0) AS n_stale_venues FROM t")
def report(spark, sf_dir):
    k = F.col("s_suppkey")
    venues = table(spark, sf_dir, "supplier").select(F.when(k % 9 < 5, k % 9 == 0).alias("stale"))
    return merge.build_report(*_snapshots(spark, sf_dir), "id", venues=venues).withColumn("churn", F.round("churn", 6))


@query("op_f9_check_rails", _REPORT + " SELECT 'churn' AS rail, round(ch / greatest(n_current, n_previous_live), 6) AS value, 0.1::DOUBLE AS bound, true AS blocks FROM t UNION ALL SELECT 'rows', n_current, 1000000000, true FROM t")
def rails(spark, sf_dir):
    return merge.check_rails(merge.build_report(*_snapshots(spark, sf_dir), "id"), min_rows=10**9).withColumn("value", F.round("value", 6))


@query("op_h1_same_except", "SELECT 'stamp' AS pair, true AS same FROM (SELECT count(*) FROM orders) UNION ALL SELECT 'value', false UNION ALL SELECT 'rows', false")
def same(spark, sf_dir):
    a = table(spark, sf_dir, "orders")
    pairs = {"stamp": a.withColumn("o_orderdate", F.col("o_orderdate") + F.expr("interval 1 day")), "value": a.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 32, F.lit("?")).otherwise(F.col("o_orderstatus"))), "rows": a.where("o_orderkey <> 32")}
    x, y, z = (merge.same_except(a, b, ["o_orderdate"]).withColumn("pair", F.lit(k)) for k, b in pairs.items())
    return x.unionByName(y).unionByName(z)


@query("op_h3_validate", """
SELECT o_orderkey AS id, 'status' AS path FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT o_orderkey, 'price' FROM orders WHERE NOT o_totalprice BETWEEN 1000 AND 100000
UNION ALL SELECT o_orderkey, 'priority' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')""")  # fmt: skip
def validate(spark, sf_dir):
    rules = {"status": F.col("o_orderstatus").isin("O", "F"), "price": F.col("o_totalprice").between(1000, 100000), "priority": F.col("o_orderpriority").rlike("^[1-3]-")}
    return audits.validate(table(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey")), rules, "id")


@query("op_h9_override_policy", "SELECT s_suppkey AS id, 'weekday' AS field FROM supplier WHERE s_suppkey % 3 = 0")
def policy(spark, sf_dir):
    fields = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("url"), F.lit("weekday"))).otherwise(F.array(F.lit("url")))
    return audits.override_policy_audit(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), fields.alias("set_fields")))


@query("op_build", f"""
WITH s AS (SELECT s_suppkey AS k, {_slug("'City ' || s_nationkey || '-' || s_name")} AS v, CASE WHEN s_suppkey % 3 = 0 THEN '21:00' ELSE '20:00' END AS t, CASE WHEN s_suppkey % 4 = 0 THEN 'biweekly' ELSE 'weekly' END AS kind FROM supplier),
e AS (SELECT v || '-mandag-' || replace(t, ':', '-') AS id, s.* FROM s)
SELECT id, v AS venue_id, CASE WHEN k % 50 = 1 THEN '18:00' ELSE t END AS time, kind, CASE WHEN k % 10 = 7 THEN DATE '2026-01-01' ELSE DATE '2026-07-28' END AS last_seen, k % 10 = 7 AS stale,
  CASE WHEN k % 10 <> 7 AND k % 2 = 0 THEN 60.0 END::DOUBLE AS lat, CASE WHEN k % 10 <> 7 THEN '0301' END AS kommune_nr FROM e
UNION ALL SELECT id || '-' || kind, v, CASE WHEN k % 50 = 1 THEN '18:00' ELSE t END, kind, DATE '2026-07-28', false, CASE WHEN k % 2 = 0 THEN 60.0 END, '0301' FROM e WHERE k % 5 = 0 AND k % 10 <> 7""")  # fmt: skip
def built(spark, sf_dir):
    """A page of one or two rows per supplier, over what was published before: all but one in ten, with one in ten that has gone."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").withColumn("_n", F.explode(F.when(k % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = s.select(
        (k * 2 + F.col("_n")).alias("row_idx"), F.lit("Oslo").alias("fylke"), F.concat(F.lit("City "), F.col("s_nationkey").cast("string")).alias("city"), F.col("s_name").alias("venue_raw"),
        F.lit(None).cast("string").alias("venue_url"), F.lit(None).cast("boolean").alias("venue_url_broken"), F.when(k % 4 == 0, F.lit("Mandag (annenhver)")).otherwise(F.lit("Mandag")).alias("weekday_raw"),
        F.when(k % 3 == 0, F.lit("kl. 21")).otherwise(F.lit("20.00")).alias("time_raw"), F.lit("Allmenn").alias("category_raw"), k.alias("supp"),
    )
    venues, events, _ = build.normalise_rows(rows.where("supp % 10 = 7 or supp % 10 < 6"))
    none = {c: F.lit(None).cast(t) for c, t in (("kommune_nr", "string"), ("kommune_name", "string"), ("fylke_now", "string"), ("lat", "double"), ("lon", "double"), ("geo_source", "string"), ("geo_confidence", "string"))}
    old = lambda d: d.withColumn("last_seen", F.lit("2026-01-01").cast("date")).withColumn("stale", F.lit(False))
    ids = rows.select(F.concat("city", F.lit("-"), "venue_raw").alias("_v"), "supp").distinct().select(T.slug(F.col("_v")).alias("venue_id"), "supp")
    cache = ids.where("supp % 2 = 0").select("venue_id", F.lit(60.0).alias("lat"), F.lit(10.0).alias("lon"), F.lit("osm").alias("geo_source"), F.lit("high").alias("geo_confidence"))
    aliases = rows.select(F.col("city").alias("place"), F.lit("0301").alias("kommune_nr"), F.lit("Oslo").alias("kommune_name"), F.lit(None).cast("string").alias("fylke_now")).distinct()
    first = events.select("id", "venue_id").join(ids, "venue_id").where("supp % 50 = 1")
    more = build.normalise_rows(rows.where("supp % 10 <> 7"))[1].select("id", "venue_id").join(ids, "venue_id").where("supp % 50 = 1")
    patch = first.unionByName(more).select("id", F.lit("18:00").alias("time"), F.array(F.lit("time")).alias("set_fields")).distinct()
    out = build.build(rows.where("supp % 10 <> 7"), "2026-07-28", (old(venues.withColumns(none)), old(events)), aliases, cache, None, patch, min_rows=1, max_churn=1.0)
    points = out.venues.select(F.col("id").alias("venue_id"), "lat", "kommune_nr")
    return out.events.join(points, "venue_id").select("id", "venue_id", "time", F.col("recurrence.kind").alias("kind"), "last_seen", "stale", "lat", "kommune_nr")


# ---- places ----


def _register(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.format_string("%04d", k).alias("nr"), F.when(k % 5 == 4, F.concat(F.lit("NATION_"), (k - 1).cast("string"))).otherwise(F.col("n_name")).alias("navn"), F.when(k % 2 == 0, F.lit("34")).otherwise(F.lit("18")).alias("fylkesnr"), F.when(k % 2 == 0, F.lit("Innlandet")).otherwise(F.lit("Nordland")).alias("fylke"))


def _places(spark, sf_dir):
    k = F.col("c_custkey")
    suffix = F.when(k % 4 == 1, F.lit(" kommune")).when(k % 4 == 2, F.lit(" i Dal")).otherwise(F.lit(""))
    return table(spark, sf_dir, "customer").select(k.alias("row_idx"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string"), suffix).alias("place"), F.get(F.array(*map(F.lit, ("Hedmark", "Nordland", "Svalbard"))), (k % 3).cast("int")).alias("fylke"))


_RESOLVE = """
WITH reg AS (SELECT lpad(n_nationkey::VARCHAR, 4, '0') AS nr, CASE WHEN n_nationkey % 5 = 4 THEN 'NATION_' || (n_nationkey - 1) ELSE n_name END AS navn, CASE WHEN n_nationkey % 2 = 0 THEN '34' ELSE '18' END AS fnr, CASE WHEN n_nationkey % 2 = 0 THEN 'Innlandet' ELSE 'Nordland' END AS now FROM nation),
pl AS (SELECT DISTINCT 'Nation ' || c_nationkey || CASE c_custkey % 4 WHEN 1 THEN ' kommune' WHEN 2 THEN ' i Dal' ELSE '' END AS place, ['Hedmark','Nordland','Svalbard'][c_custkey % 3 + 1] AS fylke, 'nation-' || c_nationkey AS key, c_custkey % 4 IN (0, 3) AS plain FROM customer),
w AS (SELECT *, CASE fylke WHEN 'Hedmark' THEN '34' WHEN 'Nordland' THEN '18' END AS want FROM pl),
j AS (SELECT w.*, reg.*, count(*) OVER (PARTITION BY place, fylke) AS n, sum(CASE WHEN fnr = want THEN 1 ELSE 0 END) OVER (PARTITION BY place, fylke) AS here FROM w JOIN reg ON key = replace(lower(navn), '_', '-')),
a AS (SELECT place, fylke, nr, navn, now, CASE WHEN n = 1 AND plain THEN 'exact' ELSE 'normalized' END AS method FROM j WHERE (n = 1 AND (plain OR want IS NULL OR fnr = want)) OR (n > 1 AND here = 1 AND fnr = want)),
amb AS (SELECT place, fylke, string_agg(navn || ' (' || nr || ')', '; ' ORDER BY navn || ' (' || nr || ')') AS c FROM j WHERE n > 1 AND here <> 1 GROUP BY 1, 2)
"""


@query("op_e7_resolve_direct", _RESOLVE + """
SELECT w.place, w.fylke, CASE WHEN a.nr IS NOT NULL THEN 'resolved' WHEN amb.c IS NOT NULL THEN 'ambiguous' ELSE 'none' END AS status, a.nr AS kommune_nr, a.navn AS kommune_name, a.now AS fylke_now, a.method, coalesce(amb.c, '') AS candidates
FROM w LEFT JOIN a USING (place, fylke) LEFT JOIN amb USING (place, fylke)""")  # fmt: skip
def resolve_direct(spark, sf_dir):
    return resolve.resolve_direct(_places(spark, sf_dir), _register(spark, sf_dir)).withColumn("candidates", F.coalesce(F.array_join("candidates", "; "), F.lit("")))


def _hits(spark, sf_dir):
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    kind = F.get(F.array(*map(F.lit, ("Gard", "By", "Sokn"))), (k % 3).cast("int"))
    # Every other one is known by its short name only.
    own = n.select(F.concat(F.lit("Nation "), k.cast("string"), F.when(k % 2 == 0, F.lit(" i Dal")).otherwise(F.lit(""))).alias("query"), F.concat(F.lit("Nation "), k.cast("string")).alias("navn"), kind.alias("type"), F.format_string("%04d", k).alias("kommunenummer"))
    return own.unionByName(own.withColumn("kommunenummer", F.format_string("%04d", (F.col("kommunenummer").cast("int") + 1) % 25)).withColumn("type", F.lit("Grend")))


_GAZ = _RESOLVE + """, h AS (SELECT 'Nation ' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN ' i Dal' ELSE '' END AS query, 'Nation ' || n_nationkey AS navn_h, t.type, lpad(t.k::VARCHAR, 4, '0') AS knr, t.rank FROM nation,
  LATERAL (SELECT * FROM (VALUES (n_nationkey, ['Gard','By','Sokn'][n_nationkey % 3 + 1], [2, 100, 75][n_nationkey % 3 + 1]), ((n_nationkey + 1) % 25, 'Grend', 60)) v(k, type, rank)) t),
s AS (SELECT place, fylke, navn_h, type, reg.nr, reg.navn, now, coalesce(fnr = want, false) AS ok, row_number() OVER (PARTITION BY place, fylke ORDER BY coalesce(fnr = want, false) DESC, rank DESC, reg.nr, navn_h) AS i FROM w JOIN h ON query = place OR (query = regexp_replace(place, '( kommune| i Dal)$', '') AND place NOT IN (SELECT query FROM h)) JOIN reg ON nr = knr),
g AS (SELECT place, fylke, max(CASE WHEN i = 1 AND ok THEN nr END) AS nr, max(CASE WHEN i = 1 AND ok THEN navn END) AS navn, max(CASE WHEN i = 1 AND ok THEN now END) AS now, string_agg(navn_h || ' [' || type || '] -> ' || navn, '; ' ORDER BY i) AS c FROM s GROUP BY 1, 2)
"""


@query("op_e8_resolve_gazetteer", _GAZ + """
SELECT place, fylke, CASE WHEN nr IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, nr AS kommune_nr, navn AS kommune_name, now AS fylke_now, CASE WHEN nr IS NOT NULL THEN 'stedsnavn' END AS method, CASE WHEN nr IS NULL THEN coalesce(c, '') ELSE '' END AS candidates FROM w LEFT JOIN g USING (place, fylke)""")  # fmt: skip
def resolve_gazetteer(spark, sf_dir):
    return resolve.resolve_gazetteer(_places(spark, sf_dir), _hits(spark, sf_dir), _register(spark, sf_dir)).withColumn("candidates", F.coalesce(F.array_join("candidates", "; "), F.lit("")))


@query("op_f12_resolution_report", _GAZ + """, f AS (SELECT 'Nation ' || c_nationkey || CASE c_custkey % 4 WHEN 1 THEN ' kommune' WHEN 2 THEN ' i Dal' ELSE '' END AS place, arg_min(['Hedmark','Nordland','Svalbard'][c_custkey % 3 + 1], c_custkey) AS fylke, c_nationkey % 6 = 0 AS known FROM customer GROUP BY ALL),
d AS (SELECT f.*, a.nr IS NOT NULL OR (amb.c IS NULL AND g.nr IS NOT NULL) AS ok FROM f LEFT JOIN a USING (place, fylke) LEFT JOIN amb USING (place, fylke) LEFT JOIN g USING (place, fylke))
SELECT 'places' AS metric, count(*) AS n FROM d UNION ALL SELECT 'known', count(*) FROM d WHERE known UNION ALL SELECT 'resolved', count(*) FROM d WHERE NOT known AND ok UNION ALL SELECT 'unresolved', count(*) FROM d WHERE NOT known AND NOT ok""")  # fmt: skip
def resolution(spark, sf_dir):
    places, existing = _places(spark, sf_dir), _known_places(spark, sf_dir)
    return resolve.resolution_report(places, existing, resolve.resolve_places(places, _register(spark, sf_dir), _hits(spark, sf_dir), existing))


def _known_places(spark, sf_dir):
    return table(spark, sf_dir, "nation").where("n_nationkey % 6 = 0").select(F.explode(F.array(*[F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string"), F.lit(s)) for s in ("", " kommune", " i Dal")])).alias("place"))


@query("op_e9_f12_resolve_places", _GAZ + """, f AS (SELECT 'Nation ' || c_nationkey || CASE c_custkey % 4 WHEN 1 THEN ' kommune' WHEN 2 THEN ' i Dal' ELSE '' END AS place, arg_min(['Hedmark','Nordland','Svalbard'][c_custkey % 3 + 1], c_custkey) AS fylke FROM customer WHERE c_nationkey % 6 <> 0 GROUP BY 1)
SELECT coalesce(a.method, CASE WHEN amb.c IS NULL AND g.nr IS NOT NULL THEN 'stedsnavn' END) AS method, count(*) AS n FROM f LEFT JOIN a USING (place, fylke) LEFT JOIN amb USING (place, fylke) LEFT JOIN g USING (place, fylke) GROUP BY 1""")  # fmt: skip
def resolve_places(spark, sf_dir):
    existing = _known_places(spark, sf_dir)
    return resolve.alias_method_counts(resolve.resolve_places(_places(spark, sf_dir), _register(spark, sf_dir), _hits(spark, sf_dir), existing))


# ---- names ----


def _names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_brand").alias("block"), F.col("p_partkey").alias("id"), F.concat(F.initcap("p_name"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" Bar")).otherwise(F.lit(""))).alias("name"))
    b = p.select(F.col("p_brand").alias("block"), F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_name"), F.lit("s"))).otherwise(F.concat(F.lit("The "), F.col("p_name"))).alias("place_name"), F.col("p_size").cast("double").alias("lat"), F.lit(10.0).alias("lon"))
    return a, b.distinct()


def _dice_sql(a: str, b: str) -> str:
    grams = lambda x: f"list_transform(range(1, length({x})), lambda i: substr({x}, i, 2))"
    common = f"list_sum(list_transform(list_distinct({grams(a)}), lambda g: least(len(list_filter({grams(a)}, lambda h: h = g)), len(list_filter({grams(b)}, lambda h: h = g)))))"
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) < 2 OR length({b}) < 2 THEN 0.0 ELSE 2.0 * {common} / (length({a}) + length({b}) - 2) END"


@query("op_b16_dice", f"SELECT a, b, round({_dice_sql('a', 'b')}, 6) AS dice FROM (SELECT DISTINCT p_name AS a, lower(p_type) AS b FROM part UNION SELECT p_name, p_name || 's' FROM part UNION SELECT p_name, p_name FROM part)")
def dice(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    others = F.explode(F.array(F.lower("p_type"), F.concat("p_name", F.lit("s")), F.col("p_name")))
    return p.select(F.col("p_name").alias("a"), others.alias("b")).distinct().select("a", "b", F.round(match.dice(F.col("a"), F.col("b")), 6).alias("dice"))


_PAIRS = f"""
WITH x AS (SELECT p_brand AS block, p_partkey AS id, p_name AS core, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' bar' ELSE '' END AS full_name FROM part),
y AS (SELECT DISTINCT p_brand AS block, CASE WHEN p_size % 2 = 0 THEN p_name || 's' ELSE 'The ' || p_name END AS place_name, CASE WHEN p_size % 2 = 0 THEN p_name || 's' ELSE p_name END AS ycore, p_size::DOUBLE AS lat FROM part),
d AS (SELECT x.block, id, core, full_name, place_name, ycore, lat, {_dice_sql('full_name', 'lower(place_name)')} AS f, {_dice_sql('core', 'ycore')} AS c FROM x JOIN y USING (block)),
m AS (SELECT *, CASE WHEN full_name = place_name THEN 1.0 WHEN core = ycore THEN 0.98 WHEN replace(core, ' ', '') = replace(ycore, ' ', '') THEN 0.97 WHEN f >= 0.82 THEN f WHEN c >= 0.9 THEN c END AS score,
  CASE WHEN full_name = place_name OR core = ycore OR replace(core, ' ', '') = replace(ycore, ' ', '') THEN 'exact' WHEN f >= 0.82 OR c >= 0.9 THEN 'fuzzy' END AS kind FROM d)"""


@query("op_e10_e12_fuzzy_block_join", _PAIRS + " SELECT id, place_name, lat, kind, round(score, 6) AS score FROM m WHERE kind IS NOT NULL")
def fuzzy(spark, sf_dir):
    a, b = _names(spark, sf_dir)
    return match.fuzzy_block_join(a, b, "block").select("id", "place_name", "lat", F.col("match.kind").alias("kind"), F.round("match.score", 6).alias("score"))


@query("op_g8_g11_best_match", _PAIRS + """, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind, score DESC, place_name, lat) AS i FROM m WHERE kind IS NOT NULL)
SELECT t.id, t.place_name, t.kind, bool_or(r.kind = t.kind AND abs(r.score - t.score) < 0.02 AND abs(r.lat - t.lat) > 0.01) AS ambiguous, CASE WHEN t.kind = 'exact' AND NOT bool_or(r.kind = t.kind AND abs(r.score - t.score) < 0.02 AND abs(r.lat - t.lat) > 0.01) THEN 'high' ELSE 'medium' END AS confidence
FROM r t JOIN r USING (id) WHERE t.i = 1 GROUP BY 1, 2, 3""")  # fmt: skip
def best(spark, sf_dir):
    a, b = _names(spark, sf_dir)
    m = match.best_match(match.fuzzy_block_join(a, b, "block"), "id")
    return m.select("id", "place_name", F.col("match.kind").alias("kind"), "ambiguous", geo.osm_confidence(F.col("match.kind"), F.col("ambiguous")).alias("confidence"))


@query("op_e11_containment", "SELECT DISTINCT p_name AS a, p_name || ' plass ' || split_part(p_name, ' ', 1) AS b, 'strong' AS kind, 0.9::DOUBLE AS score FROM part")
def contained(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.col("p_name").alias("a"), F.concat_ws(" ", "p_name", F.lit("plass"), F.split("p_name", " ")[0]).alias("b")).distinct()
    place = match.place_tokens(F.lit("Plass"))
    return match.match_names(d, "a", "b", place).select("a", "b", F.col("match.kind").alias("kind"), F.col("match.score").alias("score"))


# ---- geo ----


def _points(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    return c.select(k.alias("id"), F.when(k % 31 == 0, F.lit(0.0)).otherwise(50 + (k % 320) / 10).alias("lat"), F.when(k % 31 == 0, F.lit(0.0)).otherwise((k % 370) / 10).alias("lon"), F.when(k % 5 != 0, F.format_string("%04d", F.col("c_nationkey"))).alias("kommune_nr"), F.col("c_name").alias("name"), "c_nationkey")


_POINTS = "p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 31 = 0 THEN 0 ELSE 50 + (c_custkey % 320) / 10 END AS lat, CASE WHEN c_custkey % 31 = 0 THEN 0 ELSE (c_custkey % 370) / 10 END AS lon, CASE WHEN c_custkey % 5 <> 0 THEN lpad(c_nationkey::VARCHAR, 4, '0') END AS nr, c_nationkey AS nk FROM customer)"
_REGION = "CASE WHEN lat = 0 AND lon = 0 THEN NULL WHEN lat BETWEEN 57.5 AND 71.5 AND lon BETWEEN 4 AND 31.5 THEN 'mainland' WHEN lat BETWEEN 74 AND 81 AND lon BETWEEN 10 AND 35 THEN 'svalbard' END"


@query("op_d8_check_in_region", f"WITH {_POINTS} SELECT k AS id, {_REGION} IS NOT NULL AS ok, {_REGION} AS region, CASE WHEN lat = 0 AND lon = 0 THEN 'null island' WHEN {_REGION} IS NULL THEN 'outside' END AS reason FROM p")
def in_region(spark, sf_dir):
    return _points(spark, sf_dir).select("id", F.inline(F.array(geo.check_in_region(F.col("lat"), F.col("lon")))))


def _regions(spark, sf_dir):
    k = F.col("n_nationkey")
    lat, lon = 55 + k % 10 * 2.0, 3 + k % 7 * 4.0
    box = F.struct(lon.alias("min_lon"), lat.alias("min_lat"), (lon + 6).alias("max_lon"), (lat + 5).alias("max_lat"))
    return table(spark, sf_dir, "nation").select(F.format_string("%04d", k).alias("nr"), box.alias("bbox"), F.struct((lat + 2.5).alias("lat"), (lon + 3).alias("lon")).alias("point"))


_BOXES = "b AS (SELECT lpad(n_nationkey::VARCHAR, 4, '0') AS nr, 55 + n_nationkey % 10 * 2.0 AS la, 3 + n_nationkey % 7 * 4.0 AS lo FROM nation)"


@query("op_d9_within_bbox", f"WITH {_POINTS}, {_BOXES} SELECT k AS id, lat BETWEEN la - 0.05 AND la + 5.05 AND lon BETWEEN lo - 0.05 AND lo + 6.05 AS inside FROM p JOIN b USING (nr)")
def within(spark, sf_dir):
    d = _points(spark, sf_dir).join(_regions(spark, sf_dir), F.col("kommune_nr") == F.col("nr"))
    return d.select("id", geo.within_bbox(F.col("lat"), F.col("lon"), F.col("bbox")).alias("inside"))


@query("op_g9_distance", f"WITH {_POINTS} SELECT k AS id, round(2 * 6371 * asin(least(1, sqrt(pow(sin(radians(60 - lat) / 2), 2) + pow(sin(radians(10 - lon) / 2), 2) * cos(radians(lat)) * cos(radians(60))))), 3) AS km FROM p")
def distances(spark, sf_dir):
    return _points(spark, sf_dir).select("id", F.round(geo.distance_km(F.col("lat"), F.col("lon"), F.lit(60.0), F.lit(10.0)), 3).alias("km"))


@query("op_e13_verify_in_region", f"""WITH {_POINTS}, {_BOXES} SELECT k AS id, CASE WHEN {_REGION} IS NULL THEN 'country' WHEN p.nr IS NULL OR {_REGION} = 'svalbard' THEN NULL WHEN NOT (lat BETWEEN la - 0.05 AND la + 5.05 AND lon BETWEEN lo - 0.05 AND lo + 6.05) THEN 'box'
  WHEN k % 7 = 0 THEN 'region' END AS why FROM p LEFT JOIN b ON b.nr = p.nr""")  # fmt: skip
def verify(spark, sf_dir):
    p = _points(spark, sf_dir)
    lookup = p.select("id", F.when(F.col("id") % 7 != 0, F.col("kommune_nr")).alias("found_nr"))
    return geo.verify_in_region(p, _regions(spark, sf_dir), lookup).select("id", "why")


def _ladder_tables(spark, sf_dir):
    """Venues with names by their number modulo 200, and what each rung looks them up in; points lie about the middle of a region, at a longitude of their own."""
    k = F.col("id")
    mid = _regions(spark, sf_dir).select(F.col("nr").alias("kommune_nr"), F.col("point.lat").alias("lat"), F.col("point.lon").alias("_lon"))
    v = _points(spark, sf_dir).select("id", "kommune_nr", F.concat(F.lit("Sted "), F.md5((k % 200).cast("string"))).alias("name"), F.when(k % 10 == 1, F.concat(F.lit("Storgata "), k.cast("string"))).alias("address_hint"), F.lit("x").alias("kommune"), F.lit("y").alias("kommune_name"))
    at = v.join(mid, "kommune_nr")
    near = lambda d, step: d.withColumn("lon", F.col("_lon") + (k * 4 + step) / 10_000_000)
    # Two addresses for some hints: the first of every other one lies in another region.
    a1 = near(at.where("id % 20 = 1"), 0).select(F.upper("address_hint").alias("address"), F.col("kommune_nr").alias("nr"), "lat", "lon", k.alias("ord"), (k % 40 != 21).alias("good"))
    a2 = near(at.where("id % 80 = 21"), 1).select(F.lower("address_hint").alias("address"), F.col("kommune_nr").alias("nr"), "lat", "lon", (k + 1_000_000).alias("ord"), F.lit(True).alias("good"))
    addresses = a1.unionByName(a2)
    one = at.where("id % 9 = 2").groupBy("kommune_nr", "name", "lat", "_lon").agg(F.min("id").alias("id"))
    places = near(one, 2).select(F.col("name").alias("place_name"), "kommune_nr", "lat", "lon", (k % 2 == 1).alias("good"))
    hits = near(at.where("id % 3 <> 1"), 3).select(F.lower("name").alias("navn"), F.when(k % 2 == 0, F.lit("By")).otherwise(F.lit("Gard")).alias("type"), F.col("kommune_nr").alias("nr"), "lat", "lon", (k % 2 == 0).alias("good"))
    point = lambda d, nr: d.select("lat", "lon", F.when(F.col("good"), F.col(nr)).otherwise(F.lit("9999")).alias("found_nr"))
    lookup = point(addresses, "nr").unionByName(point(places, "kommune_nr")).unionByName(point(hits, "nr"))
    return v, addresses, places, hits, geo.by_lookup(_regions(spark, sf_dir), lookup)


#: The cap on a region's venues is one in so many of all: some regions are over it, some aren't, at any size.
_SHARE = 31
_LADDER = f"""WITH {_POINTS}, {_BOXES},
v AS (SELECT k, p.nr, k % 200 AS s, la + 2.5 AS lat, la + 2.5 BETWEEN 57.5 AND 71.5 AND lo + 3 BETWEEN 4 AND 31.5 OR la + 2.5 BETWEEN 74 AND 81 AND lo + 3 BETWEEN 10 AND 34 AS inn, la + 2.5 > 73 AS far FROM p LEFT JOIN b USING (nr)),
a AS (SELECT k AS id, lat, 'address' AS src, 'high' AS conf FROM v WHERE k % 20 = 1 AND inn AND (far OR k % 40 <> 21 OR k % 80 = 21)),
m AS (SELECT nr, s, min(k) AS mk FROM v WHERE k % 9 = 2 AND nr IS NOT NULL GROUP BY 1, 2),
o AS (SELECT k AS id, lat, 'osm' AS src, 'high' AS conf FROM v JOIN m USING (nr, s) WHERE inn AND (far OR mk % 2 = 1) AND k NOT IN (SELECT id FROM a)),
h AS (SELECT nr, s FROM v WHERE k % 3 <> 1 AND nr IS NOT NULL GROUP BY 1, 2),
g AS (SELECT k AS id, lat, 'kartverket' AS src, 'medium' AS conf FROM v JOIN h USING (nr, s) WHERE inn AND (far OR s % 2 = 0) AND k NOT IN (SELECT id FROM a) AND k NOT IN (SELECT id FROM o)),
n AS (SELECT nr, count(*) AS n FROM p WHERE nr IS NOT NULL GROUP BY 1),
c AS (SELECT k AS id, lat, 'centroid' AS src, 'low' AS conf FROM v JOIN n USING (nr) WHERE n <= (SELECT count(*) // {_SHARE} FROM p) AND inn AND k NOT IN (SELECT id FROM a) AND k NOT IN (SELECT id FROM o) AND k NOT IN (SELECT id FROM g)),
l AS (FROM a UNION ALL FROM o UNION ALL FROM g UNION ALL FROM c)"""


def _ladder(spark, sf_dir):
    v, addresses, places, hits, verify = _ladder_tables(spark, sf_dir)
    regions, cap = _regions(spark, sf_dir), v.count() // _SHARE
    rungs = [lambda d: geo.address_rung(d, addresses, verify), lambda d: geo.map_rung(d, places, verify), lambda d: geo.gazetteer_rung(d, hits, verify), lambda d: geo.centroid_rung(d, regions, whole=v, cap=cap)]
    rejected = lambda placed: geo.map_candidates(v.join(placed.where("geo_source = 'address'").select(F.col("id").alias("_id")), F.col("id").cast("string") == F.col("_id"), "left_anti"), places, verify).where("not verified")
    return v, geo.ladder(v, rungs), rejected


@query("op_e14_e16_g10_ladder", _LADDER + " SELECT id::VARCHAR AS id, lat::DOUBLE AS lat, src AS geo_source, conf AS geo_confidence FROM l")
def ladder(spark, sf_dir):
    return _ladder(spark, sf_dir)[1].select("id", "lat", "geo_source", "geo_confidence")


@query("op_f10_geocode_stats", _LADDER + """ SELECT 'total' AS metric, '' AS value, count(*) AS n FROM p UNION ALL SELECT 'missing', '', count(*) FROM p WHERE k NOT IN (SELECT id FROM l) UNION ALL SELECT 'geo_source', src, count(*) FROM l GROUP BY 2
UNION ALL SELECT 'geo_confidence', conf, count(*) FROM l GROUP BY 2""")  # fmt: skip
def geocode_stats(spark, sf_dir):
    v, placed, _ = _ladder(spark, sf_dir)
    return geo.geocode_stats(v, placed)


@query("op_f10_geocode_lists", _LADDER + """ SELECT 'missing' AS kind, k::VARCHAR AS id, NULL AS reason FROM p WHERE k NOT IN (SELECT id FROM l) UNION ALL SELECT 'low', id::VARCHAR, src FROM c
UNION ALL SELECT 'rejected', k::VARCHAR, CASE WHEN inn THEN 'region' ELSE 'country' END FROM v JOIN m USING (nr, s) WHERE NOT (inn AND (far OR mk % 2 = 1)) AND k NOT IN (SELECT id FROM a)""")  # fmt: skip
def geocode_lists(spark, sf_dir):
    v, placed, rejected = _ladder(spark, sf_dir)
    return geo.geocode_lists(v, placed, rejected(placed))


@query("op_d10_g12_only_new", f"WITH {_POINTS} SELECT k AS id FROM p WHERE k % 3 <> 0 ORDER BY coalesce(nr, '9999'), k LIMIT 100")
def only_new(spark, sf_dir):
    p = _points(spark, sf_dir)
    fresh = geo.only_new(p, p.where("id % 3 = 0").select(F.col("id").alias("venue_id")))
    return geo.limit_resolved(fresh, 100).select("id")
