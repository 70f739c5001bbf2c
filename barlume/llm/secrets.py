"""Secret scan: fixed credential patterns, and strings of high entropy.

Candidate strings are maximal runs of base64 and identifier characters, 20 or longer. Over each a
window of 20 characters slides; its Shannon entropy in bits comes from character counts that are
updated by the character entering and the one leaving, never recounted. The run's class, by the
characters it is made of, sets the threshold its highest window must reach: what 99 % of windows
of random characters of that class exceed. A run of both letters and digits can be any class; one of
letters alone is a candidate only where a quarter to three quarters of them are capitals, which
words and camel case are not. An allow-list suppresses what only looks random. Everything is
native expressions.

Defined results: a null text is empty and has no spans; rows stay one to one, repeated rows
included; ``scan`` leaves the other columns as they are, but for one of the new column's name
(``out_col``), which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlume.llm import spans

ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
#: What precedes the value in a match of ASSIGN.
ASSIGN_LEAD = r"""^(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
ASSIGN_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
_RUN = "A-Za-z0-9+/_="
CANDIDATE = rf"(?<![{_RUN}-])[{_RUN}-]{{{WINDOW},}}+"
#: class -> (pattern of the whole run, bits the highest window must reach), first that fits. The bits
#: are the 0.01 quantiles of the entropy of 20 random characters out of 16, 17, 32, 36 and 64.
CLASSES = {
    "hex": (r"^[0-9a-f]+$|^[0-9A-F]+$", 2.90),
    "hex_marked": (r"^[0-9a-f]+(?:[_=+/-][0-9a-f]+)+$|^[0-9A-F]+(?:[_=+/-][0-9A-F]+)+$", 2.94),
    "base32": (r"^[A-Z2-7]+=*$|^[a-z2-7]+=*$", 3.34),
    "one_case": (r"^[a-z0-9]+$|^[A-Z0-9]+$", 3.40),
    "any": (r"", 3.64),
}
#: Letters alone: the least length, and the least and greatest share of capitals.
LETTERS, CAPITALS = 24, (0.25, 0.75)
#: Runs that are not secrets: UUIDs, words and short numbers joined by marks, placeholders.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[/_=+-]*+(?:[A-Za-z]++|[0-9]{1,4}+)(?:[/_=+-]++(?:[A-Za-z]++|[0-9]{1,4}+))+[/_=+-]*$",
    r"(?i)example|placeholder|changeme|xxxx|0000000|1234567|abcdef[^0-9]",
)


def window_entropy(run: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of the windows of ``run`` (at least a window long).

    H = log2(w) - S / w with S the sum of c log2 c over the window's counts; a step changes two counts.
    """

    def weight(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))

    def start(at: Column) -> Column:
        return F.struct(F.transform(at["alphabet"], lambda _: F.lit(0)).alias("counts"), F.lit(0.0).alias("s"), F.lit(1e9).alias("least"))

    def best(at: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            come = F.get(at["codes"], i)
            go = F.when(i >= window, F.get(at["codes"], i - window))
            up = F.get(acc["counts"], come)
            s = acc["s"] + weight(up + 1) - weight(up)
            down = F.get(acc["counts"], go) + F.when(go == come, 1).otherwise(0)
            s = s + F.coalesce(weight(down - 1) - weight(down), F.lit(0.0))
            counts = F.transform(acc["counts"], lambda c, j: c + (j == come).cast("int") - F.coalesce((j == go).cast("int"), F.lit(0)))
            return F.struct(counts.alias("counts"), s.alias("s"), F.when(i >= window - 1, F.least(acc["least"], s)).otherwise(acc["least"]).alias("least"))

        return F.aggregate(F.sequence(F.lit(0), F.size(at["codes"]) - 1), start(at), step, lambda acc: F.log2(F.lit(float(window))) - acc["least"] / window)

    chars = F.split(run, "")
    coded = F.array(F.struct(chars.alias("chars"), F.array_distinct(chars).alias("alphabet")))
    coded = F.transform(coded, lambda x: F.struct(x["alphabet"].alias("alphabet"), F.transform(x["chars"], lambda c: (F.array_position(x["alphabet"], c) - 1).cast("int")).alias("codes")))
    return F.get(F.transform(coded, best), F.lit(0))


def _needed(run: Column) -> Column:
    """The bits of the run's class; null for one that is no candidate."""
    out = F.lit(CLASSES["any"][1])
    for pattern, bits in reversed([c for c in CLASSES.values() if c[0]]):
        out = F.when(F.rlike(run, F.lit(pattern)), F.lit(bits)).otherwise(out)
    letters, digits = F.rlike(run, F.lit("[A-Za-z]")), F.rlike(run, F.lit("[0-9]"))
    capitals = F.length(F.regexp_replace(run, "[^A-Z]", ""))
    mixed = F.rlike(run, F.lit(f"^[A-Za-z]{{{LETTERS},}}+$")) & capitals.between(CAPITALS[0] * F.length(run), CAPITALS[1] * F.length(run))
    return F.when((letters & digits) | mixed, out)


def _random(run: Column, allow: tuple[str, ...]) -> Column:
    ok = F.lit(True)
    for a in allow:
        ok = ok & ~F.rlike(run, F.lit(a))
    return F.when(ok & _needed(run).isNotNull(), window_entropy(run) >= _needed(run)).otherwise(F.lit(False))


def _long_run(text: Column) -> Column:
    return F.rlike(text, F.lit(f"[{_RUN}-]{{{WINDOW}}}"))


def entropy_spans(text: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    return F.filter(spans.matches(text, CANDIDATE, _long_run(text)), lambda x: _random(x["text"], allow))


def scan(df: DataFrame, text_col: str = "text", allow: tuple[str, ...] = ALLOW, out_col: str = "secrets") -> DataFrame:
    """``df`` with a column ``out_col``: array<struct<start, order, end, kind>>, by place, then kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = spans.matches_all(text, [(ASSIGN, None), (ACCESS, text.contains("AKIA")), (HEX, None), (CANDIDATE, _long_run(text))])

    def holds(x: Column, k: Column) -> Column:
        value = F.length(F.regexp_replace(x["text"], ASSIGN_LEAD, "")) >= ASSIGN_VALUE
        return F.when(k == 0, value).when(k == 3, _random(x["text"], allow)).otherwise(F.lit(True))

    found = F.transform(found, lambda some, k: F.filter(some, lambda x: holds(x, k)))
    return df.withColumn(out_col, F.array_sort(spans.labelled(found, KINDS)))
