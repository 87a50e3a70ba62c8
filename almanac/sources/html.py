"""Jobs over stored web pages (page_id, url, html)."""

from __future__ import annotations

import html as _html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, js_pattern, js_trim

# ---- fixed values ----
BLIND_HOSTS = ("facebook.com", "fb.com", "fb.me")
BROKEN_CLASS = "broken_link"
UPDATED = r"(?i)Sist\s+oppdatert:?\s*([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})"
# ---- end of fixed values ----

_ENTITIES = {f"&{n};": chr(c) for n, c in _html.entities.name2codepoint.items() if n != "amp"}


def decode_entities(c: Column) -> Column:
    """Named and numeric character references; &amp; last, so that nothing is decoded twice."""
    parts = F.regexp_extract_all(c, F.lit(r"(&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[A-Za-z0-9]{2,8};|[^&]+|&)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for kv in _ENTITIES.items() for x in kv])
    # F.chr only knows Latin-1, so code points go through UTF-32.
    code = lambda n: F.when((n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def one(p: Column) -> Column:
        dec = F.regexp_extract(p, "^&#([0-9]+);$", 1)
        hexa = F.regexp_extract(p, "^&#[xX]([0-9a-fA-F]+);$", 1)
        named = F.when(p == "&amp;", F.lit("&")).when(p.startswith("&") & (F.length(p) > 2), F.try_element_at(table, p))
        number = F.when(dec != "", code(dec.cast("long"))).when(hexa != "", code(F.conv(hexa, 16, 10).cast("long")))
        return F.when(p.startswith("&"), F.coalesce(number, named, p)).otherwise(p)

    return F.when(F.instr(c, "&") > 0, F.array_join(F.transform(parts, one), "")).otherwise(c)


def cell_text(c: Column) -> Column:
    """Text of a piece of HTML: br and the edges of p, div and li are line ends; lines collapsed, blank ones dropped, entities decoded."""
    t = F.regexp_replace(c, r"(?is)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)<br[^>]*>|</?(?:p|div|li)(?:\s[^>]*)?/?>", "\n")
    t = decode_entities(F.regexp_replace(t, r"(?s)</?[A-Za-z][^>]*>", ""))
    lines = F.transform(F.split(t, "\n"), lambda x: js_trim(F.regexp_replace(x, f"{WS}+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def source_updated_at(c: Column) -> Column:
    """The page's own date of change as YYYY-MM-DD, padded but not checked; null if absent."""
    d, m, y = (F.regexp_extract(c, js_pattern(UPDATED), k) for k in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def split_row_variants(df: DataFrame, time_col: str, cat_col: str) -> DataFrame:
    """Rows whose time and category have several lines become several rows if the lines pair up or one side has just one. Adds variant (0, 1, ...)."""
    seg = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), js_trim), lambda x: x != "")
    d = df.withColumn("_t", seg(time_col)).withColumn("_c", seg(cat_col))
    n = F.greatest(F.size("_t"), F.size("_c"))
    fits = (n > 1) & ((F.size("_t") == n) | (F.size("_t") == 1)) & ((F.size("_c") == n) | (F.size("_c") == 1))
    pick = lambda a, i: F.when(F.size(a) == 1, F.get(F.col(a), F.lit(0))).otherwise(F.get(F.col(a), i))
    pairs = F.when(fits, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(pick("_t", i).alias("t"), pick("_c", i).alias("c"))))
    pairs = F.coalesce(pairs, F.array(F.struct(F.col(time_col).alias("t"), F.col(cat_col).alias("c"))))
    out = d.select(*[F.col(c) for c in df.columns], F.posexplode(pairs).alias("variant", "_p"))
    return out.withColumns({time_col: F.col("_p.t"), cat_col: F.col("_p.c")}).drop("_p")


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def link_status(url: Column, css_class: Column, blind_hosts: tuple[str, ...] = BLIND_HOSTS) -> Column:
    """True where the page marks the link as dead and its checker can see that host. A url that can't be parsed counts as seen."""
    marked = F.array_contains(F.split(F.coalesce(css_class, F.lit("")), f"{WS}+"), BROKEN_CLASS)
    pattern = r"(^|\.)(" + "|".join(h.replace(".", r"\.") for h in blind_hosts) + ")$"
    blind = F.coalesce(url_host(url).rlike(pattern), F.lit(False))
    return marked & url.isNotNull() & ~blind


def html_table_rows(pages: DataFrame, table_id: str, n_cells: int = 6, missing: str = "warn") -> tuple[DataFrame, DataFrame]:
    """(rows, warnings) of the table with that id on each page.

    A row of one cell that spans several is a heading, carried down to the rows below it. Rows with another number of cells
    are warned of unless blank; rows without city and venue are dropped, those without a venue warned of. A page without the
    table (or without html) is a warning with row_idx null, or an error if missing is "error". rows: page_id, row_idx, fylke, city, venue_raw, venue_url, venue_url_broken (true
    or null), weekday_raw, time_raw, category_raw.
    """
    table = F.regexp_extract(F.coalesce("html", F.lit("")), rf"(?is)<table\b[^>]*\bid=[\"']?\Q{table_id}\E[\"'\s>].*?</table>", 0)
    if missing == "error":
        table = F.when(table == "", F.raise_error(F.concat(F.lit("no table on page "), F.col("page_id").cast("string"))).cast("string")).otherwise(table)
    found = pages.select("page_id", table.alias("_table"))
    lacking = found.where("_table = ''").select("page_id", F.lit(None).cast("int").alias("row_idx"), F.lit("no table").alias("warning"))
    tr = found.where("_table <> ''").select("page_id", F.posexplode(F.regexp_extract_all("_table", F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr>|</table>)"), F.lit(1))).alias("row_idx", "_tr"))
    cells = F.regexp_extract_all("_tr", F.lit(r"(?is)(<t[dh]\b.*?)(?=<t[dh]\b|</t[dh]>|$)"), F.lit(1))
    tr = tr.withColumn("row_idx", F.col("row_idx") + 1).withColumn("_cells", cells).where(F.size("_cells") > 0)
    tr = tr.withColumn("_text", F.transform("_cells", lambda x: cell_text(F.regexp_replace(x, r"(?is)^<t[dh]\b[^>]*>", ""))))
    span = F.regexp_extract(F.get("_cells", F.lit(0)), r"(?is)^<t[dh]\b[^>]*\bcolspan=[\"']?([0-9]+)", 1)
    flat = lambda i: F.replace(F.get("_text", F.lit(i)), F.lit("\n"), F.lit(" "))
    tr = tr.withColumn("_is_head", (F.size("_cells") == 1) & (F.coalesce(span.try_cast("int"), F.lit(1)) > 1))
    tr = tr.withColumn("_head", F.when(F.col("_is_head"), F.nullif(flat(0), F.lit(""))))
    down = Window.partitionBy("page_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    tr = tr.withColumn("fylke", F.coalesce(F.last("_head", ignorenulls=True).over(down), F.lit(""))).where(~F.col("_is_head"))
    text = F.array_join("_text", " | ")
    odd = tr.where((F.size("_cells") != n_cells) & (js_trim(text) != "")).select("page_id", "row_idx", F.concat(F.size("_cells").cast("string"), F.lit(" cells: "), F.substring(text, 1, 120)).alias("warning"))
    good = tr.where(F.size("_cells") == n_cells)
    anchor = F.regexp_extract(F.get("_cells", F.lit(2)), r"(?is)<a\b[^>]*\bhref\s*=[^>]*>", 0)
    whole = lambda name: F.regexp_extract(anchor, rf"(?is)[\s\"']{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    attribute = lambda name: F.nullif(js_trim(F.regexp_replace(whole(name), "^[\"']|[\"']$", "")), F.lit(""))
    url = decode_entities(attribute("href"))
    good = good.select(
        "page_id", "row_idx", "fylke", flat(1).alias("city"), F.get("_text", F.lit(2)).alias("venue_raw"), url.alias("venue_url"),
        F.nullif(link_status(url, attribute("class")), F.lit(False)).alias("venue_url_broken"),
        flat(3).alias("weekday_raw"), F.get("_text", F.lit(4)).alias("time_raw"), F.get("_text", F.lit(5)).alias("category_raw"),
    )
    nameless = good.where("venue_raw = '' and city <> ''").select("page_id", "row_idx", F.concat(F.lit("no venue: "), F.col("city")).alias("warning"))
    rows = split_row_variants(good.where("venue_raw <> ''"), "time_raw", "category_raw").drop("variant")
    return rows, odd.unionByName(nameless).unionByName(lacking)


def link_lint(pages: DataFrame, base: str) -> DataFrame:
    """page_id, link of root-relative links that don't start with base; //... and / alone are fine; nothing for base `/`."""
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?:href|src|srcset|action)="(/[^"]*)"'), F.lit(1))).alias("link"))
    return links.where(F.lit(base != "/") & ~F.col("link").startswith("//") & (F.col("link") != "/") & ~F.col("link").startswith(base))


def accept_snapshot(new: DataFrame, prev: DataFrame, min_bytes: int = 50_000, order: str | None = None) -> DataFrame:
    """url, accepted, changed, body: what to store. Undersized bodies are refused and the stored one stays; CRLF becomes LF.

    Pages without a url are one page, and one without a body is refused. Of several bodies of one url the last by `order` counts, here and in prev, ties by the body; without an order, the last body.
    """
    last = lambda d: d.groupBy("url").agg(F.max(F.struct(*([order] if order in d.columns else []), "html"))["html"].alias("html"))
    new, prev = last(new), last(prev)
    n = new.select("url", F.replace(F.col("html"), F.lit("\r\n"), F.lit("\n")).alias("_new"), F.coalesce(F.octet_length("html") >= min_bytes, F.lit(False)).alias("accepted"))
    prev = prev.select(F.col("url").alias("_url"), F.col("html").alias("_old"))
    out = n.join(prev, n["url"].eqNullSafe(prev["_url"]), "left")
    changed = F.col("accepted") & (F.col("_old").isNull() | (F.sha2("_new", 256) != F.sha2("_old", 256)))
    return out.select("url", "accepted", F.coalesce(changed, F.lit(False)).alias("changed"), F.when(F.col("accepted"), F.col("_new")).otherwise(F.col("_old")).alias("body"))
