"""Secret scan: pattern spans plus a randomness test battery (DataFrame functions only).

Pattern spans (``assign``, ``access``, ``hex``) come straight from regular
expressions.  On top of them every long token whose alphabet can be inferred
(hex, upper hex, base32, base36, base64) is put through three tests of the hypothesis
"symbols are independent and uniform over the inferred alphabet":

* chi-squared of the symbol counts (upper tail, Wilson-Hilferty),
* runs above and below the middle of the alphabet (two-sided),
* lag-1 serial correlation of the symbol indices (two-sided).

The smallest p-value is corrected for three tests (Sidak).  A token is reported
as ``random`` when its p-value reaches the threshold of its (encoding, length
class) stratum.  Thresholds control the share of non-random tokens among the
reported ones: the number of random tokens of a stratum is estimated from the
upper half of its p-values, where non-random ones are scarce, and the smallest
cut whose estimated false share is at most ``fdr`` is taken.  Short tokens give
the tests little power, long ones much, hence one cut per length class.  A
stratum of fewer than ``LEAST`` tokens says little by itself: it is judged with
the nearest length classes of its encoding, and where the whole encoding has fewer,
what is missing is filled up with random tokens' even p-values, so a lone random
token is reported unless its p-value is among the lowest.  The
strata (5 encodings x at most 32 length classes x 100 p-value bins) bound what
reaches the driver, whatever the corpus.

Edge cases: null and empty texts have no spans; every input row gives one
output row, so repeated rows repeat; offsets are code points, end exclusive; a
span of the battery that touches a pattern span is not reported again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import common

# The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "upperhex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<s,e,t>> of the leftmost non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(
        F.array().cast("array<string>"))
    pairs = F.arrays_zip(found.alias("m"), F.slice(parts, F.lit(1), F.size(found)).alias("b"))
    start = F.struct(F.lit(0).cast("long").alias("at"),
                     F.array().cast("array<struct<s:bigint,e:bigint,t:string>>").alias("out"))

    def step(acc, x):
        s = acc["at"] + F.length(x["b"])
        e = s + F.length(x["m"])
        return F.struct(e.cast("long").alias("at"), F.concat(acc["out"], F.array(F.struct(
            s.cast("long").alias("s"), e.cast("long").alias("e"), x["m"].alias("t")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _phi(z: Column) -> Column:
    """Normal distribution function, logistic approximation (error below 2e-4)."""
    return 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(
        F.lit(700.0), -(1.5976 * z + 0.070566 * z * z * z)))))


def _encoding(t: Column) -> Column:
    digit, low, up = t.rlike("[0-9]"), t.rlike("[a-z]"), t.rlike("[A-Z]")
    return (F.when(t.rlike("^[0-9a-f]+$") & digit & low, "hex")
            .when(t.rlike("^[0-9A-F]+$") & digit & up, "upperhex")
            .when(t.rlike("^[A-Z2-7]+$") & digit & up, "base32")
            .when(t.rlike("^[0-9a-z]+$") & digit & low, "base36")
            .when(digit & low & up, "base64"))


def _battery(x: Column) -> Column:
    """struct(s, e, enc, len_class, p) of a candidate struct(s, e, enc, k, idx)."""
    idx, k = x["idx"], x["k"].cast("double")
    n = F.size(idx).cast("double")
    counts = F.transform(F.array_distinct(idx), lambda v: F.pow(
        F.size(F.filter(idx, lambda w: w == v)).cast("double"), F.lit(2.0)))
    chi = k / n * F.aggregate(counts, F.lit(0.0), lambda a, v: a + v) - n
    df = k - 1
    z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    left, right = F.slice(idx, F.lit(1), F.size(idx) - 1), F.slice(idx, F.lit(2), F.size(idx) - 1)
    changes = F.aggregate(F.zip_with(left, right, lambda a, b: ((a < k / 2) != (b < k / 2)).cast("double")),
                          F.lit(0.0), lambda a, v: a + v)
    z_runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    mid, var = (k - 1) / 2, (k * k - 1) / 12
    serial = F.aggregate(F.zip_with(left, right, lambda a, b: (a - mid) * (b - mid)),
                         F.lit(0.0), lambda a, v: a + v)
    z_serial = serial / (var * F.sqrt(n - 1))
    p = F.least(1 - _phi(z_chi), 2 * (1 - _phi(F.abs(z_runs))), 2 * (1 - _phi(F.abs(z_serial))))
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["enc"].alias("enc"),
                    F.floor(F.log2(n)).cast("int").alias("len_class"),
                    (1 - F.pow(1 - F.least(p, F.lit(1.0)), F.lit(3.0))).alias("p"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` (pattern spans, ordered) and ``tokens`` (battery results) to the rows."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumns({
        "_assign": F.filter(_spans(t, ASSIGN), lambda x: F.length(
            F.regexp_extract(x["t"], ASSIGN, 2)) >= 6),
        "_access": _spans(t, ACCESS), "_hex": _spans(t, HEX), "_tok": _spans(t, TOKEN)})

    def ranked(name: str, rank: int) -> Column:
        return F.transform(F.col(name), lambda x: F.struct(
            x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e")))

    base = F.array_sort(F.concat(ranked("_assign", 0), ranked("_access", 1), ranked("_hex", 2)))
    d = d.withColumn("base", base)
    typed = F.filter(F.transform(
        F.filter(F.col("_tok"), lambda x: ~F.exists(F.col("base"), lambda b: (
            b["s"] < x["e"]) & (x["s"] < b["e"]))),
        lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"),
                           _encoding(x["t"]).alias("enc"))), lambda x: x["enc"].isNotNull())
    d = d.withColumn("_typed", typed)
    alphabet = F.create_map(*[F.lit(v) for kv in ALPHABETS.items() for v in kv])
    coded = F.transform(F.col("_typed"), lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["enc"].alias("enc"),
        F.length(alphabet[x["enc"]]).alias("k"),
        F.transform(F.filter(F.split(F.translate(x["t"], "-_", "+/"), ""), lambda c: c != ""),
                    lambda c: F.instr(alphabet[x["enc"]], c) - 1).alias("idx")))
    d = d.withColumn("_coded", coded)
    return d.withColumn("tokens", F.transform(F.col("_coded"), _battery)).drop(
        "_tok", "_typed", "_coded")


#: Tokens that a cut is estimated from at least.
LEAST = 50


def pooled(strata: dict, size: int, grid: int) -> list:
    """Histogram of a length class with its neighbours, up to LEAST tokens; ``strata``: length class -> histogram."""
    near = sorted(strata, key=lambda c: (abs(c - size), c))
    hist = [0.0] * grid
    for c in near:
        if sum(hist) >= LEAST:
            break
        hist = [a + b for a, b in zip(hist, strata[c])]
    lack = max(0.0, LEAST - sum(hist))
    return [a + lack / grid for a in hist]


def thresholds(scanned: DataFrame, fdr: float = 0.1, grid: int = 100) -> list:
    """(enc, len_class, cut) per stratum; at most 5 x 32 rows come back."""
    bins = (scanned.select(F.explode("tokens").alias("x"))
            .groupBy(F.col("x.enc").alias("enc"), F.col("x.len_class").alias("len_class"),
                     F.least(F.floor(F.col("x.p") * grid), F.lit(grid - 1)).cast("int").alias("b"))
            .count())
    strata: dict = {}
    for r in bins.collect():
        strata.setdefault(r["enc"], {}).setdefault(r["len_class"], [0] * grid)[max(r["b"], 0)] += r["count"]
    out = []
    for enc, own in sorted(strata.items()):
        for size in sorted(own):
            hist = pooled(own, size, grid)
            above = [sum(hist[b:]) for b in range(grid)]
            random = 2.0 * above[grid // 2]
            cut = next(b for b in range(1, grid // 2 + 1)
                       if above[b] - random * (1 - b / grid) <= fdr * above[b])
            out.append((enc, size, cut / grid))
    return out


def with_random_spans(scanned: DataFrame, cuts: list) -> DataFrame:
    """Adds ``random`` (spans of the battery) under the thresholds of ``cuts``."""
    cut = F.lit(None).cast("double")
    if cuts:
        table = F.create_map(*[F.lit(v) for e, n, c in cuts for v in (f"{e}:{n}", c)])
        keep = F.filter(F.col("tokens"), lambda x: x["p"] >= table[
            F.concat_ws(":", x["enc"], x["len_class"].cast("string"))])
    else:
        keep = F.filter(F.col("tokens"), lambda x: x["p"] >= cut)
    return scanned.withColumn("random", F.transform(keep, lambda x: F.struct(
        x["s"].alias("s"), F.lit(3).alias("rank"), x["e"].alias("e"))))


def find_secrets(docs: DataFrame, fdr: float = 0.1, id_col: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Spans of every text: id, counts per kind, ``base`` and ``random`` span arrays.

    The narrow result of the one pass over the texts is written to the shared
    folder; thresholds and the final selection read that.
    """
    kept = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
    kept = common.materialize(kept.select(
        "doc_id", F.size("_assign").cast("long").alias("n_assign"),
        F.size("_access").cast("long").alias("n_access"), F.size("_hex").cast("long").alias("n_hex"),
        "base", "tokens"), "secrets")
    return with_random_spans(kept, thresholds(kept, fdr)).drop("tokens")


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(kinds, x["rank"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                        _joined(F.array_sort(F.concat("base", "random"))).alias("spans"),
                        F.size("random").cast("long").alias("n_random"))
