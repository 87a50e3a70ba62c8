"""Queries of the ingest operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import html, listing
from ..sources.paths import shared_path
from .registry import query, table


@query("op_a1_html_table_rows", """
SELECT n_nationkey AS page_id, r_name AS fylke, 'City ' || s_nationkey AS city, s_name AS venue_raw, 'https://x.example/' || s_suppkey AS venue_url, CASE WHEN s_suppkey % 4 = 0 THEN true END AS venue_url_broken, 'Mandag' AS weekday_raw,
  v.t AS time_raw, 'Allmenn & rock' AS category_raw FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey, LATERAL (SELECT unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['19:00', '21:00'] ELSE ['20:00'] END) AS t) v""")  # fmt: skip
def table_rows(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    cls = F.when(F.col("s_suppkey") % 4 == 0, F.lit(' class="big broken_link"')).otherwise(F.lit(""))
    time = F.when(F.col("s_suppkey") % 3 == 0, F.lit("<p>19:00</p><p>21:00</p>")).otherwise(F.lit("&nbsp;20:00<br>"))
    tr = F.concat(F.lit("<tr><td></td><td>City "), F.col("s_nationkey").cast("string"), F.lit("</td><td><a href=\"https://x.example/"), F.col("s_suppkey").cast("string"), F.lit('"'), cls, F.lit(">"), F.col("s_name"), F.lit("</a></td><td>Mandag</td><td>"), time, F.lit("</td><td>Allmenn &amp; rock</td></tr>"))
    rows = s.groupBy(F.col("n_nationkey").cast("long").alias("page_id"), "r_name").agg(F.array_join(F.sort_array(F.collect_list(tr)), "\n").alias("body"))
    pages = rows.select("page_id", F.concat(F.lit('<p>x</p><table class="t" id="quiz"><tr><td colspan="6"><b>'), "r_name", F.lit("</b></td></tr><tr><td>1</td><td>odd</td></tr>"), "body", F.lit("</table>")).alias("html"))
    out, _ = html.html_table_rows(pages, "quiz")
    return out.drop("row_idx")


@query("op_a2_cell_text", r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|</?[A-Za-z][^>]*>', '', 'g'), '&copy;', '©', 'g'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '[\t-\r ]+', '', 'g')) AS tight FROM pages""")  # fmt: skip
def cells(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(html.cell_text(F.col("html")), r"[\t-\r ]+", "").alias("tight"))


@query("op_a3_source_updated_at", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS updated FROM orders")
def updated(spark, sf_dir):
    d = F.col("o_orderdate")
    text = F.concat(F.lit("<p>sist  Oppdatert: "), F.day(d).cast("string"), F.lit("."), F.month(d).cast("string"), F.lit("."), F.year(d).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", html.source_updated_at(F.when(F.col("o_orderkey") % 5 != 0, text).otherwise(F.lit("oppdatert nylig"))).alias("updated"))


@query("op_a4_split_row_variants", """
SELECT o_orderkey, i - 1 AS variant, CASE o_orderkey % 4 WHEN 0 THEN ['19:00', '21:00'][i] WHEN 1 THEN ['19:00', '21:00'][i] WHEN 2 THEN '20:00' ELSE concat('1', chr(10), '2', chr(10), '3') END AS t,
  CASE o_orderkey % 4 WHEN 0 THEN ['a', 'b'][i] WHEN 1 THEN 'a' WHEN 2 THEN ['a', 'b', 'c'][i] ELSE concat('a', chr(10), 'b') END AS c
FROM orders, LATERAL (SELECT unnest(range(1, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 2 END)) AS i) x""")  # fmt: skip
def variants(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    t = F.when(k < 2, F.lit("19:00\n21:00")).when(k == 2, F.lit("20:00")).otherwise(F.lit("1\n2\n3"))
    c = F.when(k == 0, F.lit("a\n b")).when(k == 1, F.lit("a")).when(k == 2, F.lit("a\nb\n\nc")).otherwise(F.lit("a\nb"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t"), c.alias("c"))
    return html.split_row_variants(d, "t", "c")


@query("op_a5_link_status", "SELECT page_id, page_id % 2 = 0 AND page_id % 3 <> 0 AS broken FROM pages")
def link_status(spark, sf_dir):
    url = F.when(F.col("page_id") % 3 == 0, F.lit("https://www.facebook.com/x")).otherwise(F.col("url"))
    cls = F.when(F.col("page_id") % 2 == 0, F.lit("a  broken_link")).otherwise(F.lit("broken_links"))
    return table(spark, sf_dir, "pages").select("page_id", html.link_status(url, cls).alias("broken"))


@query("op_a6_a8_listing_roundtrip", """
SELECT 'venues' AS part, s_suppkey::VARCHAR AS id, s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS lat, CASE WHEN s_suppkey % 2 = 0 THEN 'w' END AS weekday FROM supplier
UNION ALL SELECT 'quizzes', c_custkey::VARCHAR, c_name, NULL, c_mktsegment FROM customer UNION ALL SELECT 'meta', '2026-07-28', NULL, NULL, NULL""")  # fmt: skip
def roundtrip(spark, sf_dir):
    """One document of two arrays, written and read back; there is no previous one before."""
    schema = "id string, name string, lat double, weekday string"
    v = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("lat"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("w")).alias("weekday"))
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("double").alias("lat"), F.col("c_mktsegment").alias("weekday"))
    path = shared_path(spark, "listing")
    options = {"item_schemas": {"venues": schema, "quizzes": schema}, "meta": "source_updated_at date"}
    assert listing.read_previous(spark, path, **options) is None
    listing.write_document({"venues": v, "quizzes": q}, spark.range(1).select(F.lit("2026-07-28").alias("source_updated_at")), path, "id", ("weekday",))
    back = listing.read_previous(spark, path, **options)
    meta = back["meta"].select(F.lit("meta").alias("part"), F.col("source_updated_at").cast("string").alias("id"), *[F.lit(None).cast(t).alias(n) for n, t in (("name", "string"), ("lat", "double"), ("weekday", "string"))])
    return back["venues"].select(F.lit("venues").alias("part"), "*").unionByName(back["quizzes"].select(F.lit("quizzes").alias("part"), "*")).unionByName(meta)


@query("op_a7_keyed_json", "SELECT event_id, k AS key, json_extract(props, '$.' || k)::INT AS value FROM events, LATERAL (SELECT unnest(json_keys(props)) AS k) x")
def keyed(spark, sf_dir):
    noted = F.regexp_replace("props", r"^\{", '{"_note": 1, ')
    d = table(spark, sf_dir, "events").select("event_id", noted.alias("props"))
    return listing.read_keyed_json(d, "props", "int", keep=("event_id",))


@query("op_a9_map_places", """
SELECT c_custkey, c_name AS name, (CASE WHEN c_custkey % 2 = 0 THEN 60 ELSE 61 END)::DOUBLE AS lat, CASE c_custkey % 4 WHEN 0 THEN 'pub' END AS amenity FROM customer WHERE c_custkey % 4 IN (0, 1, 2) AND c_custkey % 9 <> 0 AND c_custkey % 7 <> 0""")  # fmt: skip
def map_places(spark, sf_dir):
    k = F.col("c_custkey")
    tag = F.when(k % 4 == 0, F.map_from_arrays(F.array(F.lit("amenity"), F.lit("name")), F.array(F.lit("pub"), "c_name"))).when(k % 4 == 1, F.map_from_arrays(F.array(F.lit("club"), F.lit("name")), F.array(F.lit("x"), "c_name"))).when(k % 4 == 2, F.map_from_arrays(F.array(F.lit("tourism"), F.lit("name")), F.array(F.lit("hotel"), "c_name"))).otherwise(F.map_from_arrays(F.array(F.lit("amenity"), F.lit("name")), F.array(F.lit("bank"), "c_name")))
    d = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 2 == 0, F.lit(60.0)).alias("lat"), F.when(k % 2 == 0, F.lit(10.0)).alias("lon"), F.when(k % 7 != 0, F.struct(F.lit(61.0).alias("lat"), F.lit(10.0).alias("lon"))).alias("center"), F.when(k % 9 == 0, F.map_filter(tag, lambda a, _: a != "name")).otherwise(tag).alias("tags"))
    d = d.withColumn("lat", F.when(k % 7 != 0, F.col("lat"))).withColumn("lon", F.when(k % 7 != 0, F.col("lon")))
    return listing.map_places(d, (4.0, 57.0, 32.0, 72.0)).select("c_custkey", "name", "lat", "amenity")


@query("op_a10_flatten_region", """
SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Lokal' ELSE n_name END AS navn, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey + 1::DOUBLE END AS lat, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey - 2::DOUBLE END AS min_lon, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey + 4::DOUBLE END AS max_lat FROM nation""")  # fmt: skip
def regions(spark, sf_dir):
    k = F.col("n_nationkey").cast("double")
    ring = F.array(F.array(k - 2, k), F.array(k + 2, k + 4), F.array(k, k - 1))
    d = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("Lokal")).otherwise(F.lit("")).alias("local_name"), ring.alias("ring"), F.when(F.col("n_nationkey") % 3 != 0, F.array(k, k + 1)).alias("point"))
    return listing.flatten_region(d).select("n_nationkey", "navn", F.col("point.lat").alias("lat"), F.col("bbox.min_lon").alias("min_lon"), F.col("bbox.max_lat").alias("max_lat"))


@query("op_a11_flatten_hits", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'query' END AS navn, c_nationkey::VARCHAR AS kommunenummer, 60.5::DOUBLE AS lat FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0")
def hits(spark, sf_dir):
    k = F.col("c_custkey")
    one = F.struct(F.col("c_nationkey").cast("string").alias("nr"), F.lit("n").alias("navn"))
    d = table(spark, sf_dir, "customer").select("c_custkey", F.lit("query").alias("query"), F.when(k % 2 == 0, F.col("c_name")).alias("navn"), F.when(k % 3 != 0, F.array(one, one)).otherwise(F.slice(F.array(one), 1, 0)).alias("kommuner"), F.when(k % 5 != 0, F.struct(F.lit(60.5).alias("lat"), F.lit(10.5).alias("lon"))).alias("point"))
    return listing.flatten_hits(d).select("c_custkey", "navn", "kommunenummer", "lat")


@query("op_a12_link_lint", """
SELECT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src|srcset|action)="(/[^"]*)"', 1)) AS link FROM pages) WHERE NOT starts_with(link, '//') AND link <> '/' AND NOT starts_with(link, '/th')""")  # fmt: skip
def lint(spark, sf_dir):
    return html.link_lint(table(spark, sf_dir, "pages"), "/th")


@query("op_a13_accept_snapshot", """
WITH l AS (SELECT url, max(page_id) AS page_id, arg_max(html, page_id) AS html FROM pages GROUP BY url),
p AS (SELECT url, arg_max(CASE WHEN page_id % 3 = 1 THEN replace(html, chr(13) || chr(10), chr(10)) ELSE 'old' END, page_id) AS html FROM pages WHERE page_id % 3 <> 0 GROUP BY url)
SELECT l.url, coalesce(octet_length(encode(l.html)) >= 4000, false) AS accepted, coalesce(octet_length(encode(l.html)) >= 4000, false) AND (p.html IS NULL OR p.html <> replace(l.html, chr(13) || chr(10), chr(10))) AS changed FROM l LEFT JOIN p ON l.url IS NOT DISTINCT FROM p.url""")  # fmt: skip
def snapshot(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    prev = p.where("page_id % 3 <> 0").select("url", "page_id", F.when(F.col("page_id") % 3 == 1, F.replace(F.col("html"), F.lit("\r\n"), F.lit("\n"))).otherwise(F.lit("old")).alias("html"))
    return html.accept_snapshot(p, prev, 4000, "page_id").select("url", "accepted", "changed")
