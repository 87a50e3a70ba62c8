"""Quality rules: a ledger of measurements and failure bits, evaluated once, judged by versioned policies.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import set_aside

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """One test on the measurements; its failure sets the bit of its place in RULES."""

    name: str
    fails: str  # SQL over the measurement columns


#: Bits are positions in this tuple: append only, or stored ledgers change their meaning.
RULES = (
    Rule("too_few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("mostly_symbols", "2 * n_symbols > word_chars"),
    Rule("mostly_duplicate_lines", "10 * n_dup_lines > 7 * n_lines"),
    Rule("overlong_words", "word_chars > 40 * n_words"),
)
BASE = ("too_few_words", "repeated_windows")
#: A policy is a version name and the rules that reject.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "mostly_symbols", "mostly_duplicate_lines", "overlong_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SPACE = r"[\x20\x09-\x0D]+"


def mask(rules: tuple[str, ...]) -> int:
    names = [r.name for r in RULES]
    return sum(1 << names.index(x) for x in rules)


def _step(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """df's columns `keep` plus new ones, behind a generator of one row.

    Filters and projections aren't moved past a generator, so that each step is computed once per row, whatever is done with
    the result; as plain columns they would be put together into one expression whose lambdas compute whole arrays for every
    element.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus the measurement columns (long).

    Words are maximal runs of characters other than 0x20 and 0x09-0x0D. A null text has no words and only zeros; an empty
    or blank one as well. Windows are equal if 64-bit hashes of their five words' 64-bit hashes are, within one text. All work
    is per row, without a shuffle, so that repeated rows and hot sources need no care; existing columns with the names of
    measurements are replaced, no others clash. The result can be filtered as it is.
    """
    n = WINDOW
    docs, (text,), back = set_aside(docs, {f"_{x}" for x in "twlhgsrp"}, text)
    keep = [c for c in docs.columns if c not in MEASURES]
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = _step(d, [*keep, "_t"], _w=F.filter(F.split("_t", _SPACE), lambda w: w != ""))
    d = _step(
        d,
        keep,
        n_words=F.size("_w").cast("long"),
        word_chars=F.length(F.regexp_replace("_t", _SPACE, "")).cast("long"),
        n_symbols=(F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long"),
        _l=F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        _h=F.transform("_w", lambda w: F.xxhash64(w)),
    )
    starts = F.sequence(F.lit(0), (F.col("n_words") - n).cast("int"))
    simple = [*keep, "n_words", "word_chars", "n_symbols"]
    d = _step(
        d,
        simple,
        n_lines=F.size("_l").cast("long"),
        n_dup_lines=(F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        _g=F.when(F.col("n_words") >= n, F.transform(starts, lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(n)]))),
    )
    simple += ["n_lines", "n_dup_lines"]
    # Null where no window repeats, as in most texts; the steps below leave nulls alone.
    pairs = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    d = _step(d, simple, _s=F.when(F.size(F.array_distinct("_g")) < F.size("_g"), pairs))
    again = lambda x, i: F.coalesce(x["h"] == F.get("_s", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_s", i + 1)["h"], F.lit(False))
    d = _step(d, simple, _r=F.transform("_s", lambda x, i: F.struct(x["p"].alias("p"), again(x, i).alias("again"))))
    d = _step(d, simple, _p=F.sort_array(F.transform(F.filter("_r", lambda x: x["again"]), lambda x: x["p"])))
    covered = F.aggregate("_p", F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(n), p - a["last"])).alias("n"), p.alias("last")))["n"]
    return _step(d, simple, n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long")).select(*keep, *MEASURES).transform(back)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """measure() plus fail_bits (long): bit k is set where RULES[k] fails. It may be stored and judged by later policies."""
    bits = F.lit(0).cast("long")
    for k, r in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text).withColumn("fail_bits", bits)


def judge(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Ledger rows plus base_failed and kept under the named policy; texts aren't read again."""
    fails = lambda rules: F.col("fail_bits").bitwiseAND(F.lit(mask(rules)).cast("long")) != 0
    return rows.withColumn("base_failed", fails(BASE)).withColumn("kept", ~F.col("base_failed") & ~fails(POLICIES[policy]))


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: failed, and only_by_it (rows it alone rejects, that is what leaving it out would admit).

    Rows are counted by bit mask first (at most 2 ** len(RULES) groups), so only those counts are shuffled. An empty
    ledger gives zeros.
    """
    want = mask(POLICIES[policy])
    bit = [F.lit(1 << k).cast("long") for k in range(len(RULES))]
    by = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(want).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    out = by.agg(
        *[F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(b) != 0, F.col("n"))), F.lit(0)).alias(f"f{k}") for k, b in enumerate(bit)],
        *[F.coalesce(F.sum(F.when(F.col("bits") == b, F.col("n"))), F.lit(0)).alias(f"o{k}") for k, b in enumerate(bit)],
    )
    of = [F.struct(F.lit(r.name).alias("rule"), F.col(f"f{k}").alias("failed"), F.col(f"o{k}").alias("only_by_it")) for k, r in enumerate(RULES) if want >> k & 1]
    return out.select(F.inline(F.array(*of)))
