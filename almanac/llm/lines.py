"""Lines that many documents share: explode, hash, count documents, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, sized, written

#: What is stripped at both ends of a line: 0x20 and 0x09-0x0D.
SPACE = " \t\n\v\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ("n_lines", "n_dropped", "kept")
NO_ID = -(1 << 63)


def line_key(stripped: Column) -> Column:
    """128 bits of a stripped line with A-Z lower-cased. lower() does that for lines of ASCII only; others keep their other capitals."""
    lower = F.when(F.octet_length(stripped) == F.length(stripped), F.lower(stripped)).otherwise(F.translate(stripped, _UPPER, _LOWER))
    return F.unhex(F.md5(lower.cast("binary")))


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """d, t, pos, key of all lines whose key has min_chars code points at least."""
    lines = rows.select("d", "t", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("d", "t", "pos", F.btrim("line", F.lit(SPACE)).alias("line")).where(F.length("line") >= min_chars)
    return lines.select("d", "t", "pos", line_key(F.col("line")).alias("key"))


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """key, last (the largest d) of keys found in min_docs documents (d) at least; lines is a written table.

    Keys with fewer lines than that can't reach it and go first, so that only few are told apart by document. Both counts are
    combined map-side, so a line that a third of all documents have is a few rows of the shuffle.
    """
    often = written(lines.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("key"), "often")
    by_doc = lines.select("key", "d").join(sized(often, 3), "key").groupBy("key", "d").agg(F.lit(1).alias("one"))
    return by_doc.groupBy("key").agg(F.count("*").alias("docs"), F.max("d").alias("last")).where(F.col("docs") >= min_docs).select("key", "last")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    r"""All rows of docs plus n_lines (before dropping), n_dropped (long) and kept (the lines that stay, joined by \n).

    A text is split at \n; a null or empty one has one empty line. A line's key is the line without 0x20 and 0x09-0x0D at both
    ends, A-Z lower-cased. Keys of min_chars code points and more that are found in min_docs documents lose all their lines
    except in the document with the largest id, which keeps each of them, repeated or not. Shorter keys always stay.

    Rows that share an id are one document; a null id is one, smaller than all others. Repeated rows get the same result.
    Keys are equal if their 128-bit digests are. Columns of docs named like the three added ones are replaced; inner names
    can't clash, for the row travels in a struct. An empty table gives an empty one.

    Digests of long lines are stored once; counting and the joins read them alone. A text moves only where the positions it
    loses don't fit a broadcast of counted size.
    """
    own = [c for c in docs.columns if c not in ADDED]
    clean = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in own]).alias("row"), F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("d"), clean.alias("text"))
    rows = rows.withColumn("t", F.xxhash64("text"))  # tells texts of one id apart
    lines = written(_lines(rows, min_chars), "lines")
    common = written(repeated_lines(lines, min_docs), "common")
    hits = lines.join(sized(common, 4), "key").where("d <> last")
    drops = written(hits.groupBy("d", "t").agg(F.collect_set("pos").alias("drops")), "drops")
    discard(lines, common)
    size = drops.agg(F.coalesce(F.sum(F.size("drops") + 4), F.lit(0))).first()[0]
    out = rows.join(sized(drops, -(-size // max(1, drops.count()))), ["d", "t"], "left")
    # Behind a generator, a text is split once and not for each of its lines.
    out = out.select("row", "drops", F.inline(F.array(F.struct(F.split("text", "\n").alias("parts")))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("drops"))
    kept = F.when(F.col("drops").isNull(), F.array_join("parts", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n"))
    new = F.struct(F.size("parts").cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
    return out.select("row", new.alias("new")).select("row.*", "new.*")
