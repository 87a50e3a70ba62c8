"""Queries from a merged listing to its publication: schema, alias table, timestamp, document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits, publish, resolve
from ..sources import listing
from ..sources.paths import shared_path
from .merging import _GAZ, _hits, _known_places, _places, _register
from .registry import query, table


@query("op_h3_schema_rules", """WITH o AS (SELECT o_orderkey AS k FROM orders), p AS (SELECT k, CASE WHEN k % 13 <> 0 THEN 'e' || k END AS id FROM o)
SELECT id, 'id' AS path, count(*) AS n FROM p WHERE id IS NULL GROUP BY ALL UNION ALL SELECT id, 'category', count(*) FROM p GROUP BY 1 UNION ALL SELECT id, 'weekday', count(*) FROM p WHERE k % 5 = 1 GROUP BY 1
UNION ALL SELECT id, 'time', count(*) FROM p WHERE k % 4 IN (1, 2) GROUP BY 1 UNION ALL SELECT id, 'recurrence', count(*) FROM p WHERE k % 17 = 0 GROUP BY 1
UNION ALL SELECT id, 'recurrence.kind', count(*) FROM p WHERE k % 17 <> 0 AND k % 6 IN (0, 1) GROUP BY 1 UNION ALL SELECT id, 'recurrence.week_parity', count(*) FROM p WHERE k % 17 <> 0 AND k % 8 = 3 GROUP BY 1
UNION ALL SELECT id, 'recurrence.raw', count(*) FROM p WHERE k % 17 <> 0 AND k % 10 = 0 GROUP BY 1 UNION ALL SELECT id, 'category_norm', count(*) FROM p WHERE k % 3 <> 0 GROUP BY 1""")  # fmt: skip
def schema_rules(spark, sf_dir):
    """Events that break each rule now and then: null ids, times that end in a line end, structs without a part, arrays with a null; and no column `category`."""
    k = F.col("o_orderkey")
    kind = F.when(k % 6 == 0, F.lit("daily")).when(k % 6 != 1, F.lit("weekly"))
    rec = F.struct(kind.alias("kind"), F.lit(None).cast("string").alias("rrule"), F.when(k % 10 != 0, F.lit("Mandag")).alias("raw"), F.when(k % 8 == 3, F.lit("sometimes")).when(k % 8 == 4, F.lit("odd")).alias("week_parity"))
    d = table(spark, sf_dir, "orders").select(
        F.when(k % 13 != 0, F.concat(F.lit("e"), k.cast("string"))).alias("id"), F.lit("v").alias("venue_id"), F.when(k % 5 == 1, F.lit("Mandag")).when(k % 5 != 0, F.lit("mandag")).alias("weekday"),
        F.when(k % 4 == 1, F.lit("25:00")).when(k % 4 == 2, F.lit("18:00\n")).when(k % 4 == 3, F.lit("18:00")).alias("time"), F.when(k % 17 != 0, rec).alias("recurrence"),
        F.when(k % 3 == 0, F.array(F.lit("film"))).when(k % 3 == 1, F.array(F.lit("film"), F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")).alias("category_norm"), F.lit("2026-07-28").cast("date").alias("last_seen"),
    )
    return audits.validate(d, audits.schema_rules(d, audits.EVENT), "id").groupBy("id", "path").agg(F.count("*").alias("n"))


@query("op_e9_alias_upkeep", _GAZ + """, f AS (SELECT 'Nation ' || c_nationkey || CASE c_custkey % 4 WHEN 1 THEN ' kommune' WHEN 2 THEN ' i Dal' ELSE '' END AS place, arg_min(['Hedmark','Nordland','Svalbard'][c_custkey % 3 + 1], c_custkey) AS fylke FROM customer WHERE c_nationkey % 6 <> 0 GROUP BY 1),
t AS (SELECT place, coalesce(a.nr, CASE WHEN amb.c IS NULL THEN g.nr END) AS kommune_nr, CASE WHEN a.nr IS NOT NULL THEN a.method ELSE 'stedsnavn' END AS method FROM f LEFT JOIN a USING (place, fylke) LEFT JOIN amb USING (place, fylke) LEFT JOIN g USING (place, fylke))
SELECT place, kommune_nr, method, run FROM t, (VALUES (1), (2)) r(run) WHERE kommune_nr IS NOT NULL
UNION ALL SELECT 'Nation ' || n_nationkey || s, '7777', 'manual', run FROM nation, (VALUES (''), (' kommune'), (' i Dal')) v(s), (VALUES (1), (2)) r(run) WHERE n_nationkey % 6 = 0""")  # fmt: skip
def alias_upkeep(spark, sf_dir):
    """Two runs: the second finds the table of the first. Known places are there twice, by hand and by an older run."""
    known = _known_places(spark, sf_dir).withColumns({"kommune_nr": F.lit("7777"), "kommune_name": F.lit("x"), "fylke_now": F.lit("y"), "method": F.lit("manual")})
    known = known.unionByName(known.withColumn("method", F.lit("exact")).withColumn("kommune_nr", F.lit("0000")))
    places, register, hits = _places(spark, sf_dir), _register(spark, sf_dir), _hits(spark, sf_dir)
    first = resolve.keep_aliases(places, register, hits, known)[0]
    second = resolve.keep_aliases(places, register, hits, first)[0]
    return first.select("place", "kommune_nr", "method", F.lit(1).alias("run")).unionByName(second.select("place", "kommune_nr", "method", F.lit(2).alias("run")))


def _listing(spark, sf_dir):
    k = F.col("o_orderkey")
    rec = F.struct(F.lit("weekly").alias("kind"), F.when(k % 3 == 0, F.lit('R"x"')).alias("rrule"))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("e"), (k - k % 2).cast("string")).alias("id"), F.when(k % 4 == 0, F.lit("mandag")).alias("weekday"), F.when(k % 5 == 0, F.lit("Ø\n")).alias("note"), (k / 4).alias("lat"), rec.alias("recurrence"), F.when(k % 2 == 0, F.array(F.lit("film"), F.lit("musikk"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    return {"venues": table(spark, sf_dir, "nation").where(F.lit(False)).select(F.col("n_name").alias("id")), "events": o}


@query("op_a8_document", """WITH o AS (SELECT o_orderkey AS k, o_orderkey / 4 AS lat FROM orders),
l AS (SELECT unnest(list_filter(['    {', '      "id": "e' || (k - k % 2) || '",', '      "weekday": ' || CASE WHEN k % 4 = 0 THEN '"mandag"' ELSE 'null' END || ',', CASE WHEN k % 5 = 0 THEN '      "note": "Ø\\n",' END,
  '      "lat": ' || CASE WHEN k % 4 = 0 THEN (k // 4)::VARCHAR ELSE lat::VARCHAR END || ',', '      "recurrence": {', '        "kind": "weekly"' || CASE WHEN k % 3 = 0 THEN ',' ELSE '' END, CASE WHEN k % 3 = 0 THEN '        "rrule": "R\\"x\\""' END, '      },',
  '      "tags": [' || CASE WHEN k % 2 = 1 THEN ']' ELSE '' END, CASE WHEN k % 2 = 0 THEN '        "film",' END, CASE WHEN k % 2 = 0 THEN '        "musikk"' END, CASE WHEN k % 2 = 0 THEN '      ]' END], lambda x: x IS NOT NULL)) AS line FROM o
  UNION ALL SELECT unnest(['{', '  "source_updated_at": "2026-07-28",', '  "venues": [],', '  "events": [', '  ]', '}', '    }']) UNION ALL SELECT '    },' FROM range(1, (SELECT count(*) FROM o)))
SELECT line, count(*) AS n FROM l GROUP BY line""")  # fmt: skip
def document(spark, sf_dir):
    """The lines of a document whose keys are repeated, and of an empty array."""
    path = shared_path(spark, "document") + ".json"
    listing.write_document(_listing(spark, sf_dir), spark.range(1).select(F.lit("2026-07-28").alias("source_updated_at")), path, nullable=("weekday",))
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("op_h1_publish", """SELECT step, changed, stamp, (SELECT count(*) FROM orders) - gone AS n FROM (VALUES ('first', true, '2026-07-28 04:00:00', 0), ('again', false, '2026-07-28 04:00:00', 0), ('less', true, '2026-07-30 04:00:00', 1), ('date', true, '2026-07-31 04:00:00', 1)) v(step, changed, stamp, gone)""")
def publication(spark, sf_dir):
    """Four runs: the second has the same rows in another order, the third lacks one row, the fourth has another source date."""
    tables, path = _listing(spark, sf_dir), shared_path(spark, "published")
    events = tables["events"]
    least = events.agg(F.min(F.struct("id", "lat"))).first()[0]
    less = events.where(~((F.col("id") == least["id"]) & (F.col("lat") == least["lat"])))
    runs = (("first", events, "28", "2026-07-01"), ("again", events.orderBy(F.desc("lat")), "29", "2026-07-01"), ("less", less, "30", "2026-07-01"), ("date", less, "31", "2026-07-02"))
    out = []
    for step, rows, day, source in runs:
        got = publish.publish(tables | {"events": rows}, f"2026-07-{day} 04:00:00", path, source)
        out.append(spark.read.parquet(f"{got.path}/events").agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), F.lit(got.changed).alias("changed"), F.lit(str(got.generated_at)).alias("stamp"), "n"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
