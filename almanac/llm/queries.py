"""Registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, divergence, fsttok, langid, licenses, lines, minhash, quality, runs, suffix, urlfilter, warc
from .scratch import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=100, with_text=False)
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fsttok.token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text").withColumnRenamed("text", "_text"), "_text")
    return d.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("line_ids", ",").alias("line_ids"), "license", "rule_no", F.array_join("licenses", ",").alias("licenses"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.judge(quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored ledger judged by two policies: for each rule what fails it, what it alone rejects, and what the policy keeps. Texts are read once."""
    rows = written(quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "ledger")
    out = []
    for policy in ("base", "v1"):
        kept = quality.judge(rows, policy).agg(F.count_if("kept").alias("n_kept"))
        out.append(quality.ablations(rows, policy).crossJoin(F.broadcast(kept)).withColumn("policy", F.lit(policy)))  # one row
    return out[0].unionByName(out[1])


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = urlfilter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.rules_table(spark))
    return d.select("page_id", "host", "path", "rule", "verdict")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(_table(spark, sf_dir, "documents"), min_docs=3, top=200)


def periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, the words of every tenth document (by crc32 of its id) from a on made periodic, as the query has it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    d = docs.select("doc_id", "text", F.inline(F.array(F.struct(F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g")))))
    n = F.size("w")
    d = d.select("doc_id", "text", F.inline(F.array(F.struct("w", n.alias("n"), "g", (F.col("g") % n).cast("int").alias("a")))))
    d = d.withColumn("p", (F.expr("(n - a) div (3 + g % 8)") + 1).cast("int"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    tail = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", place(i))), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = runs.periodic_runs(periodic_tails(_table(spark, sf_dir, "documents")), min_length=6, min_exponent=4)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines_of = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    d = d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines_of, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("best.less")
    return d.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.call_function("div", length * 1000, F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_license_scan": op7_license_scan,
    "op8_quality_rules": op8_quality_rules,
    "quality_ablations": quality_ablations,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_url_filters": op10_url_filters,
    "op11_line_dedup": op11_line_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": pipeline,
}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUALITY_CTE = rf"""
w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
      FROM documents),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
        FROM (SELECT doc_id, i, ws[i:i+4] AS g FROM w, unnest(range(1, len(ws) - 3)) u(i))),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM win, range(5) r(j) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, t, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM w LEFT JOIN cov USING (doc_id)),
q AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 2 * n_symbols > word_chars THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 7 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END)::BIGINT AS fail_bits FROM m)"""

_LIST = "[" + ", ".join(f"'{s}'" for s in licenses.SENTENCES) + "]"
_FITS = ", ".join(f"CASE WHEN contains(q, ',{','.join(map(str, seq))},') THEN {{'no': {k}, 'name': '{name}'}} END" for k, (name, seq) in enumerate(licenses.SEQUENCES, 1))


def _sentences(text: str, end: str) -> str:
    return f"list_filter(list_transform(string_split_regex({text}, '{end}'), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'), ' ')), lambda x: x <> '')"


def _ids(sentences: str) -> str:
    return f"list_filter(list_transform({sentences}, lambda x: coalesce(list_position({_LIST}, x), 0)), lambda x: x > 0)"


_SPLIT = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_CRC = "xor(list_reduce(list_transform(range(length(s)), lambda i: ascii(s[i + 1])::BIGINT), lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295), 4294967295)"

ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[i:i+1] AS g FROM w, unnest(range(1, greatest(len(ws), 2))) u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.x),
c AS (SELECT doc_id, min(x) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op5_suffix_dedup": """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
w AS (SELECT doc_id, i, t[i:i+99] AS g FROM b, unnest(range(1, octet_length(t) - 98)) u(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM s),
j AS (SELECT doc_id, sum(z - a + 1)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS z, string_agg(hex(t[y+1:a-1]), '' ORDER BY a) AS h FROM k JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(t) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(h, '') || hex(t[coalesce(z, 0)+1:octet_length(t)]))) AS kept_sha256
FROM b LEFT JOIN j USING (doc_id)""",
    "op7_license_scan": rf"""
WITH t AS (SELECT doc_id, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) AS raw FROM documents),
s AS (SELECT doc_id, {_sentences(f"regexp_replace(regexp_replace(raw, '{licenses.COMMENT}', '{chr(92)}1', 'g'), '{licenses.COPYRIGHT}', '{chr(92)}1' || chr(10) || '{chr(92)}2' || chr(10), 'g')", licenses.PARAGRAPH_END)} AS ss, {_sentences("raw", licenses.LINE_END)} AS ls FROM t),
i AS (SELECT doc_id, len(ss) AS n_sentences, {_ids("ss")} AS ids, {_ids("ls")} AS lids FROM s),
q AS (SELECT *, ',' || array_to_string(ids, ',') || ', ,' || array_to_string(lids, ',') || ',' AS q FROM i),
f AS (SELECT *, list_filter([{_FITS}], lambda x: x IS NOT NULL) AS f FROM q)
SELECT doc_id, n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(lids, ',') AS line_ids, f[1].name AS license, f[1].no AS rule_no,
  coalesce(array_to_string(list_transform(list_filter(f, lambda x, k: k = 1 OR NOT list_contains(list_transform(f[1:k-1], lambda y: y.name), x.name)), lambda x: x.name), ','), '') AS licenses
FROM f""",
    "op8_quality_rules": f"WITH {QUALITY_CTE} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, fail_bits FROM q",
    "quality_ablations": f"""WITH {QUALITY_CTE}, p(policy, m) AS (VALUES ('base', 3), ('v1', 31)),
r(rule, b) AS (VALUES ('too_few_words', 1), ('repeated_windows', 2), ('mostly_symbols', 4), ('mostly_duplicate_lines', 8), ('overlong_words', 16))
SELECT policy, rule, count(*) FILTER (fail_bits & b <> 0) AS failed, count(*) FILTER (fail_bits & m = b) AS only_by_it, count(*) FILTER (fail_bits & m = 0) AS n_kept FROM q, p, r WHERE m & b <> 0 GROUP BY policy, rule""",
    "op9_warc_revisits": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, h, array_to_string(list_transform(list_transform(range(8), lambda g: ('0x' || substr(h, g * 5 + 1, 5))::BIGINT),
        lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> b) & 31) + 1, 1)), '')), '') AS payload_digest FROM p),
l AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM l""",
    "op10_url_filters": r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(action, h, q) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT p.*, r.h || r.q AS rule, r.action, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.q) DESC NULLS LAST, length(r.h) DESC, r.action DESC, r.h || r.q) AS k
      FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM f WHERE k = 1""",
    "op11_line_dedup": rf"""
WITH l AS (SELECT doc_id, i, t[i] AS line, translate(trim(t[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) AS k
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents), unnest(range(1, len(t) + 1)) u(i)),
c AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id <> last) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (last IS NULL OR doc_id = last), '')) AS kept_sha256
FROM l LEFT JOIN c USING (k) GROUP BY doc_id""",
    "op12_source_divergence": rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
k AS (SELECT lang, x FROM (SELECT lang, unnest(list_distinct(ts)) AS x FROM d) GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT lang, source, x, count(*) AS c FROM (SELECT lang, source, unnest(ts) AS x FROM d) JOIN k USING (lang, x) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
a AS (SELECT lang, x, sum(c) AS c, sum(sum(c)) OVER (PARTITION BY lang) AS n FROM c GROUP BY lang, x),
p AS (SELECT lang, source, x, coalesce(c, 0) AS c, (1 + 1000000000::HUGEINT * (coalesce(c, 0) + 1) // (coalesce(n, 0) + v)) AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, x)),
q AS (SELECT lang, x, 1 + 1000000000::HUGEINT * (c + 1) // (n + v) AS q FROM a JOIN v USING (lang)),
s AS (SELECT l.lang, l.source, r.source AS item, sum((l.p - r.p) * (l.p - r.p) // r.p) AS value FROM p l JOIN p r USING (lang, x) WHERE l.source <> r.source GROUP BY ALL),
o AS (SELECT l.lang, l.source, 'pair' AS part, r.source AS item, coalesce(value, 0)::BIGINT AS value FROM g l JOIN g r ON l.lang = r.lang AND l.source <> r.source
      LEFT JOIN s ON s.lang = l.lang AND s.source = l.source AND s.item = r.source
      UNION ALL SELECT lang, source, 'term', x, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, x) WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o QUALIFY part = 'pair' OR rank <= 200""",
    "op13_periodic_runs": rf"""
WITH b AS (SELECT doc_id, {_SPLIT} AS ws, doc_id::VARCHAR AS s FROM documents),
h AS (SELECT doc_id, ws, len(ws) AS n, {_CRC} AS h FROM b),
a AS (SELECT *, h // 10 AS g, h // 10 % n AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (SELECT doc_id, n, i, ws[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS x FROM p, unnest(range(n)) u(i)),
e AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM w l JOIN w r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
f AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle, i FROM e),
m AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM f GROUP BY doc_id, q, isle HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, s, len, min(q) AS q FROM m GROUP BY doc_id, s, len),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, s, q) = 1),
k AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli, sha256(coalesce(k.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM b LEFT JOIN k USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
