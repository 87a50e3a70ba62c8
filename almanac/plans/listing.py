"""Calendar queries over a listing derived from customer and nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions.recurrence import WEEKDAYS
from ..operators import audits, merge, views
from ..operators.dedupe import collated, numbered
from .registry import query, table

START = "2026-12-28"  # seven days across the border of ISO weeks 53 and 1


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per customer at a place per nation; all columns follow from the key."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    pick = lambda values, m: F.get(F.array(*[F.lit(v) for v in values]), (k % m).cast("int"))
    kind = pick(("weekly", "biweekly", "monthly-nth", "last-of-month", "irregular", "weekly"), 6)
    pos = F.when(kind == "last-of-month", F.array(F.lit(-1))).when(kind == "monthly-nth", F.when(k % 5 == 0, F.array(F.lit(1), F.lit(3))).otherwise(F.array((k % 4 + 1).cast("int"))))
    raw = F.when(k % 7 == 0, F.lit("vanligvis mandag")).when(k % 13 == 0, F.lit("annenhver, sent i måneden")).otherwise(F.lit("mandag"))
    rule = F.struct(kind.alias("kind"), F.when(k % 11 != 0, F.lit("FREQ")).alias("rrule"), raw.alias("raw"), F.when(kind == "biweekly", pick(("odd", "even", None), 3)).alias("week_parity"), pos.alias("bysetpos"))
    items = c.select(
        k.alias("id"), (k % 40).alias("venue_id"), pick((*WEEKDAYS, None), 8).alias("weekday"),
        F.when(k % 9 != 0, F.format_string("%02d:%02d", (k % 24).cast("int"), (k % 4 * 15).cast("int"))).alias("time"), rule.alias("recurrence"),
        F.when(k % 9 == 0, F.lit("Quiz en gang i måneden")).otherwise(F.lit("Allmenn")).alias("category"),
        F.when(k % 4 == 0, F.array(F.lit("allmenn"), F.lit("film"))).when(k % 4 == 1, F.array(F.lit("musikk"))).otherwise(F.array(F.lit("allmenn"))).alias("category_norm"),
        (k % 17 == 0).alias("stale"), F.date_add(F.lit("2026-01-01").cast("date"), (k % 300).cast("int")).alias("last_seen"), F.col("c_nationkey"),
        F.when(k % 3 != 0, F.concat(F.lit("https://a.example/"), k.cast("string"))).alias("url"), F.when(k % 10 == 0, F.lit("Gata 1")).alias("address_hint"),
    )
    return items.join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("kommune"), F.concat(F.lit("F"), F.col("n_regionkey").cast("string")).alias("county")), "c_nationkey").drop("c_nationkey")


LISTING = """
WITH l AS (SELECT k AS id, k % 40 AS venue_id, ['mandag','tirsdag','onsdag','torsdag','fredag','lordag','sondag',NULL][k % 8 + 1] AS weekday,
  CASE WHEN k % 9 <> 0 THEN lpad((k % 24)::VARCHAR, 2, '0') || ':' || lpad((k % 4 * 15)::VARCHAR, 2, '0') END AS time,
  ['weekly','biweekly','monthly-nth','last-of-month','irregular','weekly'][k % 6 + 1] AS kind, CASE WHEN k % 11 <> 0 THEN 'FREQ' END AS rrule,
  CASE WHEN k % 7 = 0 THEN 'vanligvis mandag' WHEN k % 13 = 0 THEN 'annenhver, sent i måneden' ELSE 'mandag' END AS raw,
  CASE WHEN k % 6 = 1 THEN ['odd','even',NULL][k % 3 + 1] END AS parity,
  CASE WHEN k % 6 = 3 THEN [-1] WHEN k % 6 = 2 THEN CASE WHEN k % 5 = 0 THEN [1, 3] ELSE [k % 4 + 1] END END AS pos,
  CASE WHEN k % 9 = 0 THEN 'Quiz en gang i måneden' ELSE 'Allmenn' END AS category,
  CASE k % 4 WHEN 0 THEN ['allmenn','film'] WHEN 1 THEN ['musikk'] ELSE ['allmenn'] END AS cats,
  k % 17 = 0 AS stale, DATE '2026-01-01' + (k % 300)::INT AS last_seen, n_name AS kommune, 'F' || n_regionkey AS county,
  CASE WHEN k % 3 <> 0 THEN 'https://a.example/' || k END AS url, CASE WHEN k % 10 = 0 THEN 'Gata 1' END AS address_hint
  FROM (SELECT c_custkey AS k, c_nationkey FROM customer) JOIN nation ON n_nationkey = c_nationkey),
m AS (SELECT *, kind = 'irregular' OR weekday IS NULL OR (kind NOT IN ('weekly', 'biweekly') AND rrule IS NULL) AS undated,
  CASE WHEN raw LIKE 'vanligvis%' OR raw LIKE '%sent i%' THEN raw WHEN category LIKE 'Quiz%' THEN category END AS caveat,
  CASE WHEN raw LIKE 'vanligvis%' OR raw LIKE '%sent i%' THEN 'raw' WHEN category LIKE 'Quiz%' THEN 'category' END AS field FROM l),
days AS (SELECT DATE '2026-12-28' + i::INT AS date, ['mandag','tirsdag','onsdag','torsdag','fredag','lordag','sondag'][isodow(DATE '2026-12-28' + i::INT)] AS dow FROM range({n}) r(i)),
o AS (SELECT m.*, date, dow, CASE WHEN undated THEN 'undated' WHEN dow <> weekday THEN 'no' WHEN kind = 'biweekly' AND parity IS NULL THEN 'likely'
  WHEN kind = 'weekly' OR (kind = 'biweekly' AND (week(date) % 2 = 1) = (parity = 'odd'))
    OR (kind IN ('monthly-nth', 'last-of-month') AND (list_contains(pos, (day(date) + 6) // 7) OR (list_contains(pos, -1) AND date + 7 > last_day(date))))
  THEN CASE WHEN caveat IS NULL THEN 'certain' ELSE 'likely' END ELSE 'no' END AS occurrence FROM m, days),
dated AS (SELECT * FROM o WHERE occurrence IN ('certain', 'likely'))
"""
WEEK = LISTING.replace("{n}", "7")
LONG = LISTING.replace("{n}", "35")


def dates(spark: SparkSession, n: int = 7) -> DataFrame:
    return spark.range(n).select(F.date_add(F.lit(START).cast("date"), F.col("id").cast("int")).alias("date"))


@query("q_week_listing", WEEK + """
SELECT date, id, kommune, time, occurrence, row_number() OVER (PARTITION BY date ORDER BY time NULLS LAST, kommune, id) AS place_in_day FROM dated""")  # fmt: skip
def week_listing(spark, sf_dir):
    dated, _ = C.expand_occurrences(listing(spark, sf_dir), dates(spark))
    dated = dated.where("id is not null").select("date", "id", "kommune", "time", "occurrence")
    return numbered(dated, "date", "time", [collated("kommune"), F.col("id")], "place_in_day")


@query("op_c12_c17_occurrence_on", WEEK + "SELECT id, date, occurrence FROM o")
def occurrence_on(spark, sf_dir):
    d = listing(spark, sf_dir).crossJoin(F.broadcast(dates(spark)))  # seven dates
    return d.select("id", "date", C.occurrence_on(F.col("weekday"), F.col("recurrence"), F.col("category"), F.col("date")).alias("occurrence"))


@query("op_c18_c19_expand_occurrences", WEEK + """
SELECT days.date, count(id) AS n, coalesce(sum(CASE WHEN occurrence = 'certain' THEN 1 ELSE 0 END), 0)::BIGINT AS certain, (SELECT count(*) FROM m WHERE undated) AS undated
FROM days LEFT JOIN dated ON dated.date = days.date GROUP BY days.date""")  # fmt: skip
def expand(spark, sf_dir):
    dated, undated = C.expand_occurrences(listing(spark, sf_dir), dates(spark))
    out = dated.groupBy("date").agg(F.count("id").alias("n"), F.count_if(F.col("occurrence") == "certain").alias("certain"))
    return out.crossJoin(F.broadcast(undated.agg(F.count("*").alias("undated"))))


@query("op_c13_c15_caveats", WEEK + "SELECT id, caveat, field FROM m")
def caveats(spark, sf_dir):
    c = C.caveat_of(F.col("recurrence.raw"), F.col("category"))
    return listing(spark, sf_dir).select("id", c["text"].alias("caveat"), c["field"].alias("field"))


@query("op_c16_monthly_rule", LONG + """
SELECT id, date, list_contains(pos, (day(date) + 6) // 7) OR (list_contains(pos, -1) AND date + 7 > last_day(date)) AS hit FROM o WHERE pos IS NOT NULL AND dow = weekday""")  # fmt: skip
def monthly(spark, sf_dir):
    d = listing(spark, sf_dir).where("recurrence.bysetpos is not null").join(F.broadcast(dates(spark, 35).withColumn("weekday", C.weekday_of(F.col("date")))), "weekday")
    return d.select("id", "date", C.matches_monthly_rule(F.col("recurrence.bysetpos"), F.col("date")).alias("hit"))


@query("op_c20_card_status", WEEK + """
SELECT id, date, CASE WHEN undated THEN 'undated' ELSE occurrence END AS status,
  CASE WHEN occurrence = 'likely' THEN CASE WHEN kind = 'biweekly' THEN 'annenhver uke' ELSE 'sjekk selv' END END AS badge,
  CASE WHEN occurrence = 'likely' AND kind <> 'biweekly' THEN field END AS badge_reason,
  CASE WHEN undated THEN raw WHEN occurrence = 'likely' AND kind <> 'biweekly' THEN caveat END AS quoted_text FROM o""")  # fmt: skip
def cards(spark, sf_dir):
    d = listing(spark, sf_dir).crossJoin(F.broadcast(dates(spark)))
    return d.select("id", "date", F.inline(F.array(C.card_status(F.col("weekday"), F.col("recurrence"), F.col("category"), F.col("date")))))


@query("op_c7_c11_civil_dates", """
SELECT o_orderkey, o_orderdate::DATE AS d, o_orderdate::DATE + 10 AS later, ['mandag','tirsdag','onsdag','torsdag','fredag','lordag','sondag'][isodow(o_orderdate)] AS weekday,
  week(o_orderdate)::INT AS iso_week, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS dd,
  array_to_string(list_transform(range(3), lambda i: strftime(o_orderdate::DATE + i::INT, '%Y-%m-%d')), ',') AS win FROM orders""")  # fmt: skip
def civil(spark, sf_dir):
    d = table(spark, sf_dir, "orders").withColumn("d", C.civil_date(F.date_format("o_orderdate", "yyyy-MM-dd")))
    p = C.date_parts(F.col("d"))
    return d.select("o_orderkey", "d", C.add_days(F.col("d"), 10).alias("later"), C.weekday_of(F.col("d")).alias("weekday"), C.iso_week(F.col("d")).alias("iso_week"), p["year"].alias("y"), p["month"].alias("m"), p["day"].alias("dd"), F.array_join(C.week_window(F.col("d"), 3).cast("array<string>"), ",").alias("win"))


@query("op_c6_local_date", """
SELECT event_id, t::DATE AS d, strftime(t, '%H:%M') AS hm, ['mandag','tirsdag','onsdag','torsdag','fredag','lordag','sondag'][isodow(t)] AS weekday
FROM (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Oslo' AS t FROM events)""")  # fmt: skip
def local(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.local_date(F.col("ts")).alias("d"), C.local_time(F.col("ts")).alias("hm"), C.local_weekday(F.col("ts")).alias("weekday"))


# ---- filters and views ----


@query("op_d1_require_fields", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'no county' WHEN o_orderkey % 7 = 0 THEN 'no name' END AS reason FROM orders""")  # fmt: skip
def required(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.lit("x")).alias("county"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("  ")).otherwise(F.lit("n")).alias("name"))
    good, bad = views.require_fields(d, {"county": F.col("county"), "name": F.col("name")})
    return good.select("o_orderkey", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("o_orderkey", "reason"))


@query("op_d2_freshness", WEEK + "SELECT id, CASE WHEN stale OR id % 2 = 0 THEN 'stale' ELSE 'fresh' END AS part FROM l")
def freshness(spark, sf_dir):
    d = listing(spark, sf_dir).withColumn("v_stale", F.when(F.col("id") % 2 == 0, F.lit(True)))
    fresh, stale = views.partition_by_freshness(d, "stale", "v_stale")
    return fresh.select("id", F.lit("fresh").alias("part")).unionByName(stale.select("id", F.lit("stale").alias("part")))


@query("op_d3_d4_filter_listing", WEEK + "SELECT id, count(*) OVER () AS visible, true AS active FROM l WHERE weekday = 'mandag' AND list_contains(cats, 'film')")
def filtered(spark, sf_dir):
    seen, info = views.filter_listing(listing(spark, sf_dir), place="", weekday="mandag", category="film")
    return seen.select("id").crossJoin(F.broadcast(info))


@query("op_d5_prune_empty_groups", WEEK + """
SELECT kommune, count(*) AS total, sum(CASE WHEN weekday = 'mandag' AND time < '03:00' THEN 1 ELSE 0 END)::BIGINT AS visible,
  sum(CASE WHEN weekday = 'mandag' AND time < '03:00' THEN 1 ELSE 0 END) = 0 AS hidden FROM l GROUP BY kommune""")  # fmt: skip
def pruned(spark, sf_dir):
    d = listing(spark, sf_dir).withColumn("v", F.coalesce(views.filter_condition(weekday="mandag") & (F.col("time") < "03:00"), F.lit(False)))
    return views.prune_empty_groups(d, "kommune", F.col("v"), True)


@query("op_d6_tonight_view", WEEK + """
SELECT date, id, occurrence FROM dated WHERE kommune = 'NATION_7' AND date = DATE '2026-12-28' UNION ALL SELECT NULL, id, 'undated' FROM m WHERE undated AND kommune = 'NATION_7'""")  # fmt: skip
def tonight(spark, sf_dir):
    return views.tonight(listing(spark, sf_dir), START, "NATION_7").where("id is not null").select("date", "id", "occurrence")


@query("op_d6_place_view", WEEK + "SELECT id, CASE WHEN stale THEN 'stale' WHEN undated THEN 'undated' ELSE 'dated' END AS section FROM m WHERE kommune IN ('NATION_3', 'NATION_4')")
def place_view(spark, sf_dir):
    return views.section_view(listing(spark, sf_dir), F.col("kommune").isin("NATION_3", "NATION_4"), True).select("id", "section")


@query("op_d7_default_place", WEEK + "SELECT id FROM l WHERE kommune = 'NATION_5'")
def default_place(spark, sf_dir):
    return views.require_default_place(listing(spark, sf_dir), "NATION_5").where(views.filter_condition(None, default_place="NATION_5")).select("id")


@query("op_e1_orphans", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 10 = 0 THEN 'orphan' ELSE 'item' END AS part FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) OR l_partkey % 10 = 0")
def orphans(spark, sf_dir):
    dim = table(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select("p_partkey")
    items, lost = merge.join_with_orphans(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), dim, "l_partkey", "p_partkey")
    cols = lambda d, n: d.select("l_orderkey", "l_linenumber", F.lit(n).alias("part"))
    return cols(items, "item").unionByName(cols(lost, "orphan"))


@query("op_e18_venue_items", WEEK + "SELECT v AS venue_id, count(id) AS n FROM range(50) r(v) LEFT JOIN l ON venue_id = v AND NOT stale GROUP BY v")
def venue_items(spark, sf_dir):
    venues = spark.range(50).select(F.col("id").alias("venue_id"))
    live, _ = views.partition_by_freshness(listing(spark, sf_dir), "stale")
    return views.venue_items(venues, live).groupBy("venue_id").agg(F.count("id").alias("n"))


# ---- counts ----


@query("op_f1_tally", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def tally(spark, sf_dir):
    return views.tally(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("op_f2_count_by_category", WEEK + "SELECT category, count(*) AS n FROM (SELECT unnest(cats) AS category FROM l) GROUP BY 1")
def by_category(spark, sf_dir):
    return views.count_by_category(listing(spark, sf_dir))


@query("op_f3_count_by_weekday", WEEK + "SELECT weekday, count(*) AS n, list_position(['mandag','tirsdag','onsdag','torsdag','fredag','lordag','sondag'], weekday)::INT AS ord FROM l WHERE weekday IS NOT NULL GROUP BY 1")
def by_weekday(spark, sf_dir):
    return views.count_by_weekday(listing(spark, sf_dir))


@query("op_f4_group_sorted", "SELECT n_name, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_mktsegment, c_custkey) AS items FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def grouped(spark, sf_dir):
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return views.group_sorted(d, "n_name", "c_custkey", ["c_mktsegment", "c_custkey"]).select("n_name", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("op_f5_place_summary", WEEK + "SELECT kommune, count(*) AS n, arg_min(county, id) AS county FROM l GROUP BY 1")
def summary(spark, sf_dir):
    return views.place_summary(listing(spark, sf_dir), order="id")


FORMER = """WITH v AS (SELECT 'F' || (c_nationkey % 5) AS fylke, CASE WHEN c_nationkey % 3 = 0 THEN 'F' || (c_nationkey % 4) END AS now, n_name AS kommune FROM customer JOIN nation ON n_nationkey = c_nationkey),
c AS (SELECT coalesce(now, fylke) AS county, fylke AS former, kommune FROM v)"""


def _former(spark, sf_dir):
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    part = lambda m: F.concat(F.lit("F"), (F.col("c_nationkey") % m).cast("string"))
    return d.select(part(5).alias("fylke"), F.when(F.col("c_nationkey") % 3 == 0, part(4)).alias("fylke_now"), F.col("n_name").alias("kommune"))


@query("op_f6_former_regions", FORMER + """
SELECT county, former, CASE WHEN county IN (SELECT county FROM c WHERE county = former) THEN string_agg(DISTINCT kommune, ',' ORDER BY kommune) ELSE '' END AS places FROM c WHERE county <> former GROUP BY county, former""")  # fmt: skip
def former(spark, sf_dir):
    return views.former_regions(_former(spark, sf_dir)).withColumn("places", F.array_join("places", ","))


@query("op_f7_venues_per_region", "SELECT n_regionkey::VARCHAR AS kommune_nr, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey <> 2 GROUP BY 1")
def per_region(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return views.venues_per_region(d.select(F.when(F.col("n_regionkey") != 2, F.col("n_regionkey").cast("string")).alias("kommune_nr")))


@query("op_f11_normalize_stats", WEEK + """
SELECT count(*) AS n_items, count_if(len(cats) > 1)::BIGINT AS n_multi, count(address_hint) AS n_with_address, count_if(time IS NULL)::BIGINT AS n_without_time, count_if(kind = 'weekly')::BIGINT AS n_weekly,
  count_if(kind = 'biweekly')::BIGINT AS n_biweekly, count_if(kind = 'monthly-nth')::BIGINT AS n_monthly_nth, count_if(kind = 'last-of-month')::BIGINT AS n_last_of_month, count_if(kind = 'irregular')::BIGINT AS n_irregular FROM l""")  # fmt: skip
def stats(spark, sf_dir):
    return views.normalize_stats(listing(spark, sf_dir))


@query("op_f13_about_kpis", WEEK + """
SELECT count(DISTINCT venue_id) AS n_venues, count(DISTINCT kommune) AS n_places, count(DISTINCT county) AS n_counties, count_if(undated)::BIGINT AS n_undated, count_if(time IS NULL)::BIGINT AS n_no_time,
  count_if(len(cats) > 1)::BIGINT AS n_multi, count(DISTINCT CASE WHEN url IS NOT NULL THEN venue_id END) AS n_with_url, count_if(caveat IS NOT NULL AND NOT undated)::BIGINT AS n_caveated FROM m WHERE NOT stale""")  # fmt: skip
def kpis(spark, sf_dir):
    d = listing(spark, sf_dir).where("not stale")
    return views.about_kpis(d.withColumn("caveat", C.caveat_of(F.col("recurrence.raw"), F.col("category"))))


@query("op_f14_window_totals", WEEK + "SELECT count(*) AS total, count_if(kommune = 'NATION_7')::BIGINT AS total_default FROM dated")
def totals(spark, sf_dir):
    return views.window_totals(C.expand_occurrences(listing(spark, sf_dir), dates(spark))[0], "NATION_7")


@query("op_f15_stale_last_seen", WEEK + "SELECT max(last_seen) AS last_seen FROM l WHERE stale")
def last_seen(spark, sf_dir):
    return views.stale_last_seen(listing(spark, sf_dir))


@query("op_f16_places_overview", WEEK + "SELECT county, kommune, n, n_county_venues FROM (SELECT county, kommune, count(*) AS n FROM l GROUP BY 1, 2) JOIN (SELECT county, count(DISTINCT venue_id) AS n_county_venues FROM l GROUP BY 1) USING (county)")
def overview(spark, sf_dir):
    return views.places_overview(listing(spark, sf_dir))


@query("op_f17_upcoming_days", WEEK + "SELECT venue_id, date, count(*) AS n FROM dated GROUP BY 1, 2")
def upcoming(spark, sf_dir):
    return views.upcoming_days(C.expand_occurrences(listing(spark, sf_dir), dates(spark))[0])


@query("op_e17_data_credits", """
SELECT CASE WHEN s.src = 'osm' THEN unnest(['openstreetmap', 'kartverket']) ELSE 'kartverket' END AS credit FROM (SELECT DISTINCT ['osm', 'address', 'manual', 'newsource'][s_suppkey % 4 + 1] AS src FROM supplier WHERE s_suppkey % 3 <> 0) s WHERE s.src IN ('osm', 'address')
UNION SELECT 'unknown: ' || src FROM (SELECT DISTINCT ['osm', 'address', 'manual', 'newsource'][s_suppkey % 4 + 1] AS src FROM supplier WHERE s_suppkey % 3 <> 0) WHERE src = 'newsource'""")  # fmt: skip
def credits(spark, sf_dir):
    k = F.col("s_suppkey")
    d = table(spark, sf_dir, "supplier").select(F.when(k % 3 != 0, F.lit(60.0)).alias("lat"), F.lit(10.0).alias("lon"), F.get(F.array(*map(F.lit, ("osm", "address", "manual", "newsource"))), (k % 4).cast("int")).alias("geo_source"))
    owed, unknown = views.data_credits(d)
    return owed.select("credit").unionByName(unknown.select(F.concat(F.lit("unknown: "), "geo_source").alias("credit")))


# ---- audits ----


@query("op_h4_conservation", WEEK + "SELECT id, CASE WHEN id % 50 = 1 AND undated THEN 'lost' ELSE 'both' END AS problem FROM m WHERE (id % 50 = 1 AND undated) OR (id % 70 = 3 AND undated)")
def conservation(spark, sf_dir):
    from ..functions.calendar import is_undated

    items = listing(spark, sf_dir).withColumn("u", is_undated(F.col("weekday"), F.col("recurrence")))
    dated = items.where("not u or id % 70 = 3")
    undated = items.where("u and id % 50 <> 1")
    return audits.conservation_audit(items, dated, undated)


@query("op_h5_reachability", LONG.replace("ELSE [k % 4 + 1] END END AS pos", "WHEN k % 4 = 2 THEN [6] ELSE [k % 4 + 1] END END AS pos") + "SELECT id FROM m WHERE NOT undated AND id NOT IN (SELECT id FROM dated)")
def reachability(spark, sf_dir):
    # A sixth Monday never comes: those items are beyond any horizon.
    never = (F.col("recurrence.kind") == "monthly-nth") & (F.col("id") % 5 != 0) & (F.col("id") % 4 == 2)
    pos = F.when(never, F.array(F.lit(6))).otherwise(F.col("recurrence.bysetpos"))
    return audits.reachability_audit(listing(spark, sf_dir).withColumn("recurrence", F.col("recurrence").withField("bysetpos", pos)), F.lit(START).cast("date"))


_ODD_TEXTS = ("mandag klokka sju", "Mandag 1/9-15/12", "Mandager (2024)", "mandagen", "lordag", " MANDAGER ", "Lørdag")  # the last two are bare


@query("op_h6_unexplained_weekly", WEEK + """
SELECT id, 'unexplained' AS problem FROM m WHERE kind = 'weekly' AND NOT undated AND raw = 'mandag' AND id % 19 = 2 AND id % 7 < 5 AND id % 9 <> 0
UNION ALL SELECT -c_custkey, 'gone' FROM customer WHERE c_custkey % 100 = 0 AND c_custkey > 0""")  # fmt: skip
def unexplained(spark, sf_dir):
    text = F.get(F.array(*map(F.lit, _ODD_TEXTS)), (F.col("id") % 7).cast("int"))
    raw = F.when((F.col("id") % 19 == 2) & (F.col("recurrence.raw") == "mandag"), text).otherwise(F.col("recurrence.raw"))
    items = listing(spark, sf_dir).withColumn("recurrence", F.col("recurrence").withField("raw", raw))
    reviewed = items.where("id % 9 = 0").select("id").unionByName(items.where("id % 100 = 0 and id > 0").select((-F.col("id")).alias("id")))
    return audits.unexplained_weekly_audit(items, reviewed)


@query("op_h7_caveat_share", WEEK + "SELECT round(avg(CASE WHEN caveat IS NOT NULL THEN 1 ELSE 0 END), 6) AS share, avg(CASE WHEN caveat IS NOT NULL THEN 1 ELSE 0 END) <= 0.1 AS ok FROM m WHERE NOT undated")
def share(spark, sf_dir):
    d = listing(spark, sf_dir)
    return audits.caveat_share_audit(d.withColumn("caveat", C.caveat_of(F.col("recurrence.raw"), F.col("category")))).withColumn("share", F.round("share", 6))


@query("op_h8_navigation", FORMER + """
SELECT DISTINCT county AS name, 'no page' AS problem FROM c WHERE county <> 'F0' UNION ALL SELECT 'F9', 'dead page' UNION ALL SELECT DISTINCT former, 'not mentioned' FROM c WHERE former <> county AND former <> 'F1'""")  # fmt: skip
def navigation(spark, sf_dir):
    v = _former(spark, sf_dir)
    pages = spark.createDataFrame([("F0",), ("F9",)], "county string")
    return audits.navigation_audit(v, pages, views.former_regions(v).where("former = 'F1'"))
