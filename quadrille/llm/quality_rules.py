"""Quality rules whose cutoffs carry a guarantee.

Every rule rejects texts above a cutoff. Labelled clean documents are a holdout: for each stratum, rule and candidate cutoff
the exact binomial tail tells whether the rate of false rejections is below the allowed risk. The chance of error is divided
among strata and rules (Bonferroni), and within a rule cutoffs are tested in a fixed order. Of the cutoffs that pass, the one that catches most known bad documents is taken, and of equals
the most lenient. A stratum with too few labels gets no cutoff. Rows are handled by DataFrame functions alone; the driver sees
counts per stratum, rule and cutoff.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import staged, text_of

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
#: Languages with enough text to be strata; all others form one.
STRATA = ("en", "de", "fr", "es")
#: Each rule: its name and candidate cutoffs (reject above).
RULES = {
    "symbol_share": (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3),
    "upper_share": (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6),
    "shout_share": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0),
    "dup_line_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "repeat_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
}
#: Allowed false rejections per stratum over all rules, and the chance that any of the guarantees fails.
RISK, DELTA = 0.05, 0.05
MIN_WORDS = 50


def measures(docs: DataFrame) -> DataFrame:
    """Counts per row, from the whole text (null: empty).

    ``n_repeat_words``: the starts of 3-word windows are sorted by the window's hash inside the row, equal neighbours mark
    repeated windows, and the words they cover are counted once.
    """
    text = text_of(docs)
    words = F.array_remove(F.split(text, SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(
        "doc_id",
        F.col("lang"),
        words.alias("words"),
        F.length(text).cast("long").alias("n_code_points"),
        F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long").alias("n_upper"),
        (F.length(text) - F.length(F.regexp_replace(text, "!+", ""))).cast("long").alias("n_shouts"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    n = F.size("words")
    hashed = F.transform("words", lambda w: F.xxhash64(w))
    starts = F.when(
        n >= 3,
        F.sort_array(F.zip_with(F.sequence(F.lit(0), n - 3), F.slice("hashes", 1, F.greatest(n - 2, F.lit(0))), lambda i, h: F.struct(F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2)).alias("h"), i.alias("i")))),
    )
    same = lambda i, j: F.get("starts", i)["h"].eqNullSafe(F.get("starts", j)["h"])
    repeated = F.transform(F.filter("starts", lambda x, k: F.when(k > 0, same(k, k - 1)).otherwise(F.lit(False)) | same(k, k + 1)), lambda x: x["i"])
    covered = F.size(F.array_distinct(F.flatten(F.array(F.col("rep"), F.transform("rep", lambda x: x + 1), F.transform("rep", lambda x: x + 2)))))
    return (
        base.withColumn("n_words", n.cast("long"))
        .withColumn("hashes", hashed)
        .withColumn("starts", starts)
        .withColumn("rep", repeated)
        .withColumn("n_repeat_words", F.when(n >= 3, covered).otherwise(0).cast("long"))
        .drop("words", "hashes", "starts", "rep")
    )


def rule_values() -> dict[str, Column]:
    """The value of each rule, from the counts; 0 where there is nothing to divide by."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "shout_share": share("n_shouts", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise("other")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of Binomial(n, p), summed in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


@dataclass(frozen=True)
class Cutoff:
    stratum: str
    rule: str
    cutoff: float
    clean: int
    false_rejections: int
    caught: int


def choose(counts: list[dict], risk: float = RISK, delta: float = DELTA) -> list[Cutoff]:
    """The certified cutoff of each stratum and rule. ``counts``: clean rows, and clean and bad rows above each cutoff.

    Cutoffs are tested from the most lenient to the strictest until one fails, so a sequence costs one share of ``delta``.
    """
    level, each = delta / max(1, len(counts) * len(RULES)), risk / len(RULES)
    found = []
    for row in counts:
        for rule, cutoffs in RULES.items():
            passed = []
            for i in sorted(range(len(cutoffs)), key=lambda i: -cutoffs[i]):
                c = Cutoff(row["stratum"], rule, cutoffs[i], row["clean"], row[f"{rule}_{i}_clean"], row[f"{rule}_{i}_bad"])
                if binomial_tail(c.false_rejections, c.clean, each) > level:
                    break
                passed.append(c)
            if passed and (best := max(passed, key=lambda x: (x.caught, x.cutoff))).caught:
                found.append(best)
    return found


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> list[Cutoff]:
    """Cutoffs from the labelled rows: quality 1 is clean, 0 is bad; other labels count as neither. At most one row per stratum returns.

    A repeated id is one trial of the binomial, however many rows it has: the least of its rows is taken.
    """
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    each = measured.withColumn("stratum", stratum(F.col("lang"))).withColumns(rule_values()).join(marks, "doc_id")
    rows = each.groupBy("doc_id").agg(F.min(F.struct("stratum", *RULES, "quality")).alias("x")).select("x.*")
    clean, bad = F.col("quality") == 1, F.col("quality") == 0
    sums = [F.count_if(clean).alias("clean")] + [F.count_if(which & (F.col(rule) > c)).alias(f"{rule}_{i}_{name}") for rule, cutoffs in RULES.items() for i, c in enumerate(cutoffs) for name, which in (("clean", clean), ("bad", bad))]
    return choose([r.asDict() for r in rows.groupBy("stratum").agg(*sums).orderBy("stratum").collect()], risk, delta)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(measured: DataFrame, cutoffs: list[Cutoff]) -> DataFrame:
    """Add base_failed, the first rule that rejects (null if none) and kept."""
    values = rule_values()
    hits = [F.when((stratum(F.col("lang")) == c.stratum) & (values[c.rule] > c.cutoff), c.rule) for c in cutoffs]
    return measured.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.coalesce(*hits, F.lit(None).cast("string"))).withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Judge every row. Null and empty texts have no words and fail; ties and repeated rows are judged alike; extra columns are dropped."""
    measured = staged(measures(docs), "op10-measures")
    return judge(measured, calibrate(measured, labels, risk, delta))
