"""URL filters [native]: rules first, then a character language-model ratio.

Rules (host and path prefix) judge the urls they fit. Those urls are the labelled examples from which two smoothed
variable-order Markov models are trained, one of accepted and one of rejected urls: n-gram counts over 32 symbols,
each order interpolated with the shorter one by Witten and Bell's weights, so that a context unseen at one length
falls back to its suffix. A url without a rule is accepted when its log-likelihood difference, divided by its length,
reaches a threshold calibrated on labelled urls that the models have not seen (largest difference of true and false
acceptance rates). Model size is fixed (32**ORDER values), whatever the number of urls.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import written

#: (verdict, host, path): fixed values of the contract.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Symbols 1 to 31; 0 is the boundary before and after a url. Digits count as 0, anything else as _.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-_"
SYMBOLS = 32
ORDER = 4

#: Bins of the calibration, 1 / BIN wide, to +-BINS.
BIN, BINS = 200, 2000


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.call_function("instr", url, F.lit("://"))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return _lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge_by_rules(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for what, h, p in sorted(RULES if rules is None else rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def gram_codes(url: Column) -> Column:
    """Array of the ORDER-gram codes of a url, one for each symbol and one for the end."""
    plain = F.regexp_replace(F.regexp_replace(_lower(F.coalesce(url, F.lit(""))), "[0-9]", "0"), "[^a-z0/.\\-]", "_")
    padded = F.filter(F.split(F.concat(F.lit("~" * (ORDER - 1)), plain, F.lit("~")), ""), lambda c: c != "")
    codes = F.transform(padded, lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    n = F.size(codes) - (ORDER - 1)
    parts = F.arrays_zip(*[F.slice(codes, k + 1, n).alias(f"s{k}") for k in range(ORDER)])
    return F.transform(parts, lambda z: sum((z[f"s{k}"] * SYMBOLS ** (ORDER - 1 - k) for k in range(1, ORDER)), z["s0"] * SYMBOLS ** (ORDER - 1)))


def _as_array(table: DataFrame, cols: list[str], size: int) -> str:
    """View with one row: arrays of the columns by `code`, 0 to size - 1 (all present); gathered in two levels."""
    low = 10
    view = f"skein_url_{uuid.uuid4().hex}"
    (
        table.select(F.shiftright("code", low).alias("_hi"), F.struct("code", *cols).alias("_s"))
        .groupBy("_hi").agg(F.sort_array(F.collect_list("_s")).alias("_a"))
        .select("_hi", *[F.col(f"_a.{c}").alias(c) for c in cols])
        .agg(F.sort_array(F.collect_list(F.struct("_hi", *cols))).alias("_b"))
        .select(*[F.flatten(F.col(f"_b.{c}")).alias(c) for c in cols])
    ).transform(lambda d: written(d, "url-model")).createOrReplaceTempView(view)
    assert size > 0
    return view


def _at(view: str, col: str, index: str) -> Column:
    return F.get(F.expr(f"(SELECT {col} FROM {view})"), F.expr(index).cast("int"))


def train(labelled: DataFrame) -> str:
    """From rows (grams array<int>, ok boolean): view with one row, the array `ratio` of log p_accepted - log p_rejected."""
    spark = labelled.sparkSession
    counts = written(
        labelled.select("ok", F.explode("grams").alias("code")).groupBy("code")
        .agg(F.sum(F.col("ok").cast("long")).alias("a"), F.sum((~F.col("ok")).cast("long")).alias("r")), "url-counts",
    )
    last = None
    for order in range(1, ORDER + 1):
        size = SYMBOLS**order
        own = counts.groupBy((F.col("code") % size).cast("long").alias("code")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        full = spark.range(size).withColumnRenamed("id", "code").join(own, "code", "left").select("code", *[F.coalesce(c, F.lit(0)).alias(c) for c in "ar"])
        w = W.partitionBy(F.shiftright("code", 5))
        full = full.withColumns({f"{f}_{c}": (F.sum(c) if f == "n" else F.sum((F.col(c) > 0).cast("long"))).over(w) for c in "ar" for f in "nt"})
        lower = {c: F.lit(1.0 / SYMBOLS) if last is None else _at(last, f"p_{c}", f"code % {SYMBOLS ** (order - 1)}") for c in "ar"}
        p = {c: F.when(F.col(f"n_{c}") == 0, lower[c]).otherwise((F.col(c) + F.col(f"t_{c}") * lower[c]) / (F.col(f"n_{c}") + F.col(f"t_{c}"))) for c in "ar"}
        full = full.select("code", p["a"].alias("p_a"), p["r"].alias("p_r"))
        if order < ORDER:
            last = _as_array(full, ["p_a", "p_r"], size)
        else:
            last = _as_array(full.select("code", (F.log("p_a") - F.log("p_r")).cast("float").alias("ratio")), ["ratio"], size)
    return last


def calibrate(scored: DataFrame) -> DataFrame:
    """One row, `threshold`: from rows (llr, ok) the cut of the largest true less false acceptance rate (of ties
    the one nearest 0, then the higher); 0 where a class is empty."""
    bins = scored.select(F.least(F.greatest(F.floor(F.col("llr") * BIN), F.lit(-BINS)), F.lit(BINS)).alias("bin"), "ok")
    counts = bins.groupBy("bin").agg(F.sum(F.col("ok").cast("long")).alias("a"), F.sum((~F.col("ok")).cast("long")).alias("r"))
    down, all_ = W.orderBy(F.desc("bin")), W.partitionBy()  # at most 2 * BINS + 1 rows
    rates = counts.select("bin", F.sum("a").over(down).alias("ta"), F.sum("r").over(down).alias("tr"), F.sum("a").over(all_).alias("na"), F.sum("r").over(all_).alias("nr"))
    ta, tr, na, nr = (F.col(c).cast("decimal(18,0)") for c in ("ta", "tr", "na", "nr"))
    gain = ta * nr - tr * na  # the difference of the rates times na and nr, exact, so that ties are ties
    best = rates.where("na > 0 AND nr > 0").agg(F.max(F.struct(gain.alias("gain"), (-F.abs("bin")).alias("near"), "bin")).alias("best"))
    return best.select(F.coalesce(F.col("best.bin") / F.lit(float(BIN)), F.lit(0.0)).alias("threshold"))


def filter_urls(pages: DataFrame, rules=None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, llr, threshold.

    A null url, or one without ://, has an empty host and path; it is still scored by its characters. Without examples
    of both verdicts every ratio and the threshold are 0, which accepts. Repeated rows are judged alike. Other columns
    are ignored. An empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url"), F.monotonically_increasing_id().alias("rid"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    rule, verdict = judge_by_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict, "test": F.pmod(F.xxhash64("_url"), F.lit(5)) == 0, "grams": gram_codes(F.col("_url"))})
    rows = written(rows.drop("_url"), "url-rows")  # pages are read once
    model = train(rows.where("by_rule IS NOT NULL AND NOT test").select("grams", (F.col("by_rule") == "allow").alias("ok")))
    # Symbols are summed where they are read, so a row a page is shuffled; exploded rows hold no strings, however long.
    llr = F.sum(_at(model, "ratio", "code").cast("double")) / F.count("*")
    scores = rows.select("rid", F.explode("grams").alias("code")).groupBy("rid").agg(llr.alias("llr"))
    scored = written(rows.drop("grams").join(scores, "rid"), "url-scores")
    cut = f"skein_url_{uuid.uuid4().hex}"
    written(calibrate(scored.where("by_rule IS NOT NULL AND test").select("llr", (F.col("by_rule") == "allow").alias("ok"))), "url-cut").createOrReplaceTempView(cut)
    return scored.withColumn("threshold", F.expr(f"(SELECT threshold FROM {cut})")).select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("llr") >= F.col("threshold"), "allow").otherwise("block")).alias("verdict"), "llr", "threshold",
    )
