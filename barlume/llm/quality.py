"""Quality rules with risk-controlled thresholds.

Every document gets counts; fixed base limits reject outright. Four further rules reject where a
ratio exceeds a cutoff. The cutoffs come from a labelled holdout: for each stratum (language) and
rule the candidate cutoffs are walked from the loosest to stricter ones, and at each the exact
(Clopper-Pearson) upper bound of the share of good documents it would reject is compared with
the rule's share of ``alpha``, alpha divided by the number of rules. The walk stops at the first that
fails, so all cutoffs passed hold together (fixed-sequence testing). Every rule is tested on all
of the stratum's holdout, whatever the other rules do, at the level ``delta`` divided by the number
of strata times rules (Bonferroni). So with probability 1 - delta no rule loses more than its
share, and no stratum more than alpha, of its good documents. Of the passed cutoffs the one is
taken that rejects most bad documents net of ``penalty`` times the good ones, the loosest of equals;
where none is certain or useful the rule is off in that stratum.

Counts cover all documents and all labels. What is gathered is a histogram of fixed size per
stratum and rule.

Defined results: a null or empty text has no words and fails the base limits; a null stratum is
one of its own; a document without a label takes no part in fitting; of several labels of a
document the lowest counts; a null label is none; repeated rows stay, one to one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barlume.llm.common import materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ALPHA = 0.08
DELTA = 0.05
PENALTY = 5.0
BINS = 200
#: Strata up to this number are held as a literal map; beyond it the cutoffs are joined.
STRATA_IN_PLAN = 64

#: rule -> ratio in 0..1 whose excess rejects
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "least(word_chars / greatest(n_words, 1), 40) / 40",
}

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of one whole text.

    Words are split at ASCII white space; a word repeats if a 3-word window over it occurs twice or more.
    """
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split knows exactly the six ASCII spaces
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    repeat = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < n - 2:
            seen: dict[tuple, int] = {}
            for w in windows:
                seen[w] = seen.get(w, 0) + 1
            upto = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeat += i + 3 - max(i, upto)
                    upto = i + 3
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeat


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """(doc_id, stratum, counts) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "stratum", *(x.split()[0] for x in _COUNTS.split(", "))]
        for b in batches:
            found = [counts(t.as_py()) for t in b.column(2)]
            columns = zip(*found, strict=True) if found else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.col(stratum_col).cast("string") if stratum_col else F.lit("")).alias("stratum"),
        F.col(text_col).cast("string").alias("text"),
    )
    return rows.mapInArrow(run, f"doc_id long, stratum string, {_COUNTS}")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns. Counts are taken once more rather than joined, so
    texts are not shuffled."""
    measured = materialize(measure(docs, id_col, text_col, stratum_col), "quality-counts")
    cutoffs = fit(measured, labels, alpha=alpha, delta=delta)
    at, n = docs.columns.index(text_col), len(docs.columns)
    names = [f"__in{i}" for i in range(n)]
    schema = ", ".join([*(f"{c} {f.dataType.simpleString()}" for c, f in zip(names, docs.schema.fields, strict=True)), _COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [counts(t.as_py()) for t in b.column(at)]
            columns = zip(*found, strict=True) if found else [()] * 6
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in columns)], names=[*names, *(x.split()[0] for x in _COUNTS.split(", "))])

    rows = docs.mapInArrow(run, schema)
    stratum = F.col(names[docs.columns.index(stratum_col)]).cast("string") if stratum_col else F.lit("")
    kept = judge(rows.withColumn("stratum", stratum), cutoffs).where("kept")
    return kept.select(*(F.col(a).alias(b) for a, b in zip(names, docs.columns, strict=True)))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _bin(rule: str) -> F.Column:
    """0..BINS; a cutoff c keeps bins up to c."""
    return F.expr(f"cast(ceil(least(greatest({RULES[rule]}, 0), 1) * {BINS}) as int)")


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate at which k or fewer of n have probability delta."""
    if k >= n:
        return 1.0

    def below(p: float) -> float:
        if p <= 0:
            return 1.0
        if p >= 1:
            return 0.0
        lp, lq = math.log(p), math.log1p(-p)
        top = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq for i in range(k + 1)]
        m = max(top)
        return math.exp(m) * sum(math.exp(x - m) for x in top)

    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) > delta else (lo, mid)
    return hi


def choose(good: list[int], bad: list[int], alpha: float, delta: float, penalty: float = PENALTY) -> int | None:
    """The cutoff bin from the good and bad holdout documents per bin, or None."""
    n, n_bad = sum(good), sum(bad)
    best, chosen, wrong, right = 0.0, None, 0, 0
    if not n or not n_bad:
        return None
    for cut in range(len(good) - 2, -1, -1):  # keeps bins up to cut
        wrong += good[cut + 1]
        right += bad[cut + 1]
        if wrong > alpha * n or upper_bound(wrong, n, delta) > alpha:
            break
        gain = right / n_bad - penalty * wrong / n
        if gain > best + 1e-12:
            best, chosen = gain, cut
    return chosen


def fit(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) from the labelled rows of ``measured`` that pass the base limits."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).alias("label"))
    held = measured.where(~base_failed()).join(known, "doc_id")
    marks = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), _bin(r).alias("bin")) for r in RULES))).alias("at")
    bins = held.select("stratum", "label", marks).groupBy("stratum", "at.rule", "at.bin").agg(
        F.count_if(F.expr("label > 0")).alias("good"), F.count_if(F.expr("label <= 0")).alias("bad")
    )
    bins = materialize(bins, "quality-bins")
    level = delta / max(1, bins.select("stratum").distinct().count() * len(RULES))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        good, bad = [0] * (BINS + 1), [0] * (BINS + 1)
        for b, g, x in zip(part["bin"], part["good"], part["bad"], strict=True):
            good[b], bad[b] = int(g), int(x)
        cut = choose(good, bad, alpha / len(RULES), level)
        return pd.DataFrame({"stratum": part["stratum"].iloc[:1], "rule": part["rule"].iloc[:1], "cutoff": [cut]}).dropna(subset=["cutoff"])

    # a group is a stratum's histogram of a rule: 201 rows at most
    return materialize(bins.groupBy("stratum", "rule").applyInPandas(one, "stratum string, rule string, cutoff int"), "quality-cutoffs")


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with base_failed, rule_failed (the first rule that rejects, else null) and kept."""
    rows = cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    rows = rows.select(F.col("stratum").alias("__s"), *(F.col(r).alias(f"__{r}") for r in RULES))
    some = rows.limit(STRATA_IN_PLAN + 1).collect()
    if len(some) <= STRATA_IN_PLAN:
        cut = {r: F.lit(None).cast("int") for r in RULES}
        for s in some:
            for r in RULES:
                cut[r] = F.when(F.col("stratum").eqNullSafe(F.lit(s["__s"])), F.lit(s[f"__{r}"]).cast("int")).otherwise(cut[r])
        out = measured.withColumns({f"__{r}": cut[r] for r in RULES})
    else:
        out = measured.join(rows, measured["stratum"].eqNullSafe(rows["__s"]), "left").drop("__s")
    failed = F.coalesce(*(F.when(_bin(r) > F.col(f"__{r}"), F.lit(r)) for r in RULES))
    out = out.withColumns({"base_failed": base_failed(), "rule_failed": failed}).drop(*(f"__{r}" for r in RULES))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule_failed").isNull())


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Measures, fits and judges every row of ``docs``."""
    measured = materialize(measure(docs, id_col, text_col, stratum_col), "quality-counts")
    return judge(measured, fit(measured, labels, alpha=alpha, delta=delta))
