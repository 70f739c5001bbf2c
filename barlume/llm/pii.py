"""Personal data: fixed patterns, and boosted trees over high-recall candidates.

Base spans come from strict patterns with checks (octets, Luhn, digit counts). Besides, four
generous generators propose overlapping candidates: strings around an at sign, dotted number groups,
long groups of digits with separators, and addresses whose marks are spelled out. Each is
described by seven small integers of format and context. Gradient-boosted trees of depth two tell
personal data from the rest. What they learn from is not what the patterns know alone:

* positive are candidates that a pattern confirms, each also with the mark gone by which
  the pattern knows it (a phone number without its plus and country code, an address with its
  marks spelled out), so that the format and context around remain to be learnt;
* negative are candidates that no pattern confirms;
* those of them before which a word of contact stands are unlabelled rather than negative, and count as
  ``UNSURE`` of a negative, the share of them taken to be no personal data.

The word of contact is evidence for a label only and never a feature: as a feature it would give the label
away, and whatever follows "call" would be redacted.

On documents held out by hash an isotonic fit turns scores into probabilities, over all three kinds, and
the lowest score whose probability is ``SURE`` or more is the threshold for redacting candidates that no base
span covers. A corpus where a format mostly stands for something else thus keeps it unredacted.

The features take at most ``SIZES`` multiplied values, 8,640, so the counts per value (of all
candidates) are all that training needs; that table, and nothing that grows with the corpus, comes
to the driver, and the model goes out as one bit per value. Scanning and scoring are native
expressions without a shuffle.

Defined results: a null text is empty and has no spans; rows stay one to one, repeated rows
included; without candidates of both kinds no span is added; the other columns
stay, but for one of the new column's name (``out_col``), which it replaces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from barlume.llm import spans
from barlume.llm.common import materialize

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?+[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
KINDS = ("email", "ip", "card", "phone", "pii")

#: Candidate generators, in order.
GENERATORS = (
    r"(?<![^\x20\x09-\x0D@])[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){2,}+",
    r"[+(]?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+",
    r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
)
#: What tells that a generator may find something, at little cost.
HINTS = (r"@", None, None, r"[\[(]\x20?[aA][tT]\x20?[\])]")
ANY_HINT = r"[0-9@\[(]"
CUES = r"(?i)mail|phone|mobile|fax|tel|call|reach|card|visa|addr|contact|\bip\b"
FEATURES = ("generator", "digits", "marks", "plus", "length", "before", "after")
SIZES = (4, 6, 5, 2, 4, 3, 3)
ROUNDS, RATE, SURE, UNSURE, HELD_OUT = 40, 0.3, 0.95, 0.5, 5
LEAST_HELD = 20  # candidates that a probability must rest on


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    twice = F.transform(F.split(F.reverse(_digits(text)), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(twice, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def base_spans(text: Column) -> Column:
    """The strict patterns' spans, an array for each of the first four ``KINDS``."""
    found = spans.matches_all(text, [(EMAIL, text.contains("@")), (IP, None), (CARD, None), (PHONE, text.contains("+"))])

    def holds(x: Column, k: Column) -> Column:
        n = F.length(_digits(x["text"]))
        card = F.when(n.between(16, 19), _luhn(x["text"])).otherwise(F.lit(False))
        return F.when(k == 0, F.lit(True)).when(k == 1, F.rlike(x["text"], F.lit(OCTETS))).when(k == 2, card).otherwise(n.between(8, 15))

    return F.transform(found, lambda some, k: F.filter(some, lambda x: holds(x, k)))


def _edge(char: Column) -> Column:
    """0 for white space or none, 1 for a letter or digit, 2 for another mark."""
    return F.when(F.rlike(char, F.lit(r"^[\p{L}\p{N}]")), 1).when(F.rlike(char, F.lit(r"^\S")), 2).otherwise(0)


def _bucket(n: Column, bounds: tuple[int, ...]) -> Column:
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(n < bounds[i], i).otherwise(out)
    return out


#: What is taken from a confirmed phone number to learn its format without the mark that gives it away.
PLUS = r"^\+[0-9]{1,3}[\x20.-]?"
CANDIDATE = f"array<struct<start:int,end:int,covered:boolean,cue:boolean,{','.join(f'{f}:int' for f in FEATURES)}>>"


def _describe(g: Column, t: Column, before: Column, after: Column) -> list[Column]:
    n = F.length(_digits(t))
    marks = (
        F.when(F.rlike(t, F.lit(r"[^0-9\x20().+-]")), 4)
        .when(F.rlike(t, F.lit(r"[()]")), 3)
        .when(F.rlike(t, F.lit(r"\.")), 2)
        .when(F.rlike(t, F.lit(r"[\x20-]")), 1)
        .otherwise(0)
    )
    values = (
        g,
        _bucket(n, (8, 11, 13, 16, 20)),
        marks,
        F.startswith(t, F.lit("+")).cast("int"),
        _bucket(F.length(t), (10, 16, 24)),
        before,
        after,
    )
    return [v.cast("int").alias(k) for k, v in zip(FEATURES, values, strict=True)]


def candidates(text: Column, base: Column, learn: bool = False) -> Column:
    """array<struct<start, end, covered, cue, the features>> of all generators; ``covered``: a span of ``base``
    overlaps it; ``cue``: a word of contact stands before. With ``learn``: also spans of ``base`` as they look without
    their mark, all ``covered``."""

    def as_found(some: Column, g: Column, known: bool, change=lambda t: t) -> Column:
        return F.transform(some, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), change(x["text"]).alias("text"), g.alias("g"), F.lit(known).alias("known")))

    def describe(once: Column):
        def covered(x: Column) -> Column:
            def by(kind: Column) -> Column:
                last = spans.below(kind["starts"], x["end"]) - 1
                return (F.size(kind["starts"]) > 0) & (last >= 0) & F.coalesce(F.get(kind["spans"], last)["end"] > x["start"], F.lit(False))

            return F.exists(once["base"], by)

        def one(x: Column) -> Column:
            lead = spans.cut(once["pieces"], F.greatest(x["start"] - 24, F.lit(0)), x["start"])
            after = _edge(spans.cut(once["pieces"], x["end"], x["end"] + 1))
            ahead = F.struct(_edge(F.right(lead, F.lit(1))).alias("edge"), F.rlike(lead, F.lit(CUES)).alias("cue"))
            values = spans.bound(ahead, lambda a: F.struct(a["cue"].alias("cue"), *_describe(x["g"], x["text"], a["edge"], after)))
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), (x["known"] | covered(x)).alias("covered"), values.alias("f"))

        return one

    def with_context(found: Column) -> Column:
        starts = F.transform(base, lambda some: F.struct(F.transform(some, lambda b: b["start"]).alias("starts"), some.alias("spans")))
        once = F.struct(spans.chunks(text).alias("pieces"), starts.alias("base"))
        described = spans.bound(once, lambda o: F.transform(found, describe(o)))
        flat = F.transform(described, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["covered"].alias("covered"), *(x["f"][f].alias(f) for f in ("cue", *FEATURES))))
        return F.when(F.size(found) > 0, flat).otherwise(F.array().cast(CANDIDATE))

    found = F.transform(spans.matches_all(text, [(p, h and F.rlike(text, F.lit(h))) for p, h in zip(GENERATORS, HINTS, strict=True)]), lambda some, g: as_found(some, g, False))
    if learn:
        bare = as_found(F.get(base, F.lit(3)), F.lit(2), True, lambda t: F.regexp_replace(t, PLUS, ""))
        spelled = as_found(F.get(base, F.lit(0)), F.lit(3), True, lambda t: F.regexp_replace(F.regexp_replace(t, "@", " [at] "), r"\.", " [dot] "))
        found = F.concat(found, F.array(bare, spelled))
    return spans.bound(F.flatten(found), with_context)


# --- boosting --------------------------------------------------------------------------------------


@dataclass
class Model:
    """trees: (feature, bound, left, right): a value below the bound goes left; a leaf is a number."""

    prior: float = 0.0
    trees: list = field(default_factory=list)
    threshold: float = math.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for t in self.trees:
            out += _run(t, x)
        return out

    def accepted(self) -> np.ndarray:
        """Whether each value of the features, numbered with the last one fastest, reaches the threshold."""
        x = np.stack(np.unravel_index(np.arange(math.prod(SIZES)), SIZES), axis=1)
        return self.score(x).round(6) >= self.threshold

    def column(self, x: Column) -> Column:
        """``accepted`` of a candidate, read from one bit."""
        bits = np.packbits(np.resize(self.accepted(), -(-math.prod(SIZES) // 32) * 32), bitorder="little").view("<u4")
        at = F.lit(0)
        for f, n in zip(FEATURES, SIZES, strict=True):
            at = at * n + x[f]
        word = F.get(F.lit([int(b) for b in bits]).cast("array<bigint>"), F.floor(at / 32).cast("int"))
        return F.call_function("shiftright", word, at % 32) % 2 == 1


def _run(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, bound, left, right = tree
    return np.where(x[:, f] < bound, _run(left, x), _run(right, x))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float = 1.0):
    gain = lambda a, b: a * a / (b + ridge)
    whole, best = gain(g.sum(), h.sum()), (1e-6, None)
    if depth:
        for f, size in enumerate(SIZES):
            gs, hs = np.bincount(x[:, f], g, size).cumsum(), np.bincount(x[:, f], h, size).cumsum()
            for bound in range(1, size):
                better = gain(gs[bound - 1], hs[bound - 1]) + gain(gs[-1] - gs[bound - 1], hs[-1] - hs[bound - 1]) - whole
                if better > best[0]:
                    best = (better, (f, bound))
    if best[1] is None:
        return float(-RATE * g.sum() / (h.sum() + ridge))
    f, bound = best[1]
    low = x[:, f] < bound
    return (f, bound, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def isotonic(scores: np.ndarray, pos: np.ndarray, n: np.ndarray) -> list[tuple[float, float, float]]:
    """Pooled (lowest score, probability, weight), ascending: adjacent violators merged."""
    out: list[list[float]] = []
    for i in np.argsort(scores, kind="stable"):
        if out and out[-1][0] == scores[i]:
            out[-1][1] += pos[i]
            out[-1][2] += n[i]
        else:
            out.append([float(scores[i]), float(pos[i]), float(n[i])])
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            _, p, m = out.pop()
            out[-1][1] += p
            out[-1][2] += m
    return [(s, p / m, m) for s, p, m in out]


def boost(rows: list[tuple]) -> Model:
    """From (features..., held out, positive, negative): trees and threshold. Counts may be fractions."""
    table, k = np.array(rows, dtype=np.float64).reshape(-1, len(FEATURES) + 3), len(FEATURES)
    x, held, pos, neg = table[:, :k].astype(np.int64), table[:, k] > 0, table[:, k + 1], table[:, k + 2]
    learn = ~held
    if not pos[learn].sum() or not neg[learn].sum() or not held.any():
        return Model()
    m = Model(prior=math.log(pos[learn].sum() / neg[learn].sum()))
    score = np.full(int(learn.sum()), m.prior)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        n = pos[learn] + neg[learn]
        tree = _grow(x[learn], n * p - pos[learn], n * p * (1 - p), 2)
        m.trees.append(tree)
        score += _run(tree, x[learn])
    for at, p, n in isotonic(m.score(x[held]).round(6), pos[held], (pos + neg)[held]):
        if p >= SURE and n >= LEAST_HELD:
            m.threshold = at
            break
    return m


def _candidates_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, held, base, candidates) of every row, to learn from and to judge: texts are read once for both."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = (F.pmod(F.xxhash64(id_col, text), F.lit(HELD_OUT)) == 0).cast("int")
    some = F.rlike(text, F.lit(ANY_HINT))
    both = spans.bound(base_spans(text), lambda base: F.struct(_ordered(base).alias("base"), candidates(text, base, learn=True).alias("candidates")))
    kept = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.when(some, both).alias("x"))
    return kept.select("id", "held", F.coalesce("x.base", F.array().cast(FOUND)).alias("base"), F.coalesce("x.candidates", F.array().cast(CANDIDATE)).alias("candidates"))


def _learnt(rows: DataFrame) -> Model:
    """From ``held`` and ``candidates``."""
    counted = rows.select("held", F.explode("candidates").alias("x")).groupBy(*(F.col(f"x.{f}").alias(f) for f in FEATURES), "held").agg(
        F.count_if(F.col("x.covered")).alias("pos"), F.sum(F.when(F.col("x.covered"), 0.0).when(F.col("x.cue"), UNSURE).otherwise(1.0)).alias("neg")
    )
    return boost([tuple(r) for r in counted.collect()])  # at most 2 * 8,640 rows


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Trains on every candidate of ``docs``."""
    return _learnt(_candidates_of(docs, id_col, text_col))


FOUND = "array<struct<start:int,order:int,end:int,kind:string>>"


def _ordered(base: Column) -> Column:
    known = F.array_sort(F.transform(spans.labelled(base, KINDS[:4]), lambda x: F.struct(x["order"], x["start"], x["end"], x["kind"])))
    return F.transform(known, lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["end"].alias("end"), x["kind"].alias("kind")))


def _added(some: Column, model: Model) -> Column:
    """The spans of candidates that no base span covers and the model accepts."""
    extra = F.filter(some, lambda x: ~x["covered"] & model.column(x))
    extra = F.array_sort(F.transform(extra, lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("order"), x["end"].alias("end"), F.lit(KINDS[4]).alias("kind"))))
    return spans.bound(extra, lambda e: F.filter(e, lambda x, i: (i == 0) | (F.get(e, i - 1) != x)))  # two generators may find the same


def found_spans(text: Column, model: Model) -> Column:
    """array<struct<start, order, end, kind>>: base spans and the model's, by kind, then place."""

    def every(base: Column) -> Column:
        if not model.accepted().any():
            return _ordered(base)
        return F.concat(_ordered(base), _added(candidates(text, base), model))

    return F.when(F.rlike(text, F.lit(ANY_HINT)), spans.bound(base_spans(text), every)).otherwise(F.array().cast(FOUND))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pii): all spans of every row of ``docs``, by kind, then place. Trains on ``docs``; candidates are written
    once, so that learning and judging read no text a second time."""
    rows = materialize(_candidates_of(docs, id_col, text_col), "pii-candidates")
    model = _learnt(rows)
    return rows.select("id", F.concat("base", _added(F.col("candidates"), model)).alias("pii") if model.accepted().any() else F.col("base").alias("pii"))


def redact(text: Column, found: Column) -> Column:
    """``text`` with every span, overlapping ones merged, replaced by its kind in brackets (the first's)."""

    def replace(o: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            upto = F.get(o["upto"], i)
            put = F.concat(spans.cut(o["pieces"], upto, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.when(s["start"] >= upto, put).otherwise(F.lit(""))

        tail = spans.cut(o["pieces"], F.array_max(F.transform(o["found"], lambda s: s["end"])), o["n"])
        return F.concat(F.array_join(F.transform(o["found"], piece), ""), tail)

    def once(by_place: Column) -> Column:
        ends = spans.running(F.transform(by_place, lambda s: s["end"]), most=True)
        return spans.bound(F.struct(by_place.alias("found"), ends.alias("upto"), spans.chunks(text).alias("pieces"), F.length(text).alias("n")), replace)

    return F.when(F.size(found) > 0, spans.bound(F.array_sort(found), once)).otherwise(text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, out_col: str = "pii") -> DataFrame:
    """``docs`` with a column ``out_col`` (in place of one of that name): all spans, by kind, then place. Trains on
    ``docs`` unless given a model."""
    model = model or fit(docs, id_col, text_col)
    return docs.withColumn(out_col, found_spans(F.coalesce(F.col(text_col).cast("string"), F.lit("")), model))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; a null text stays null."""
    model = model or fit(docs, id_col, text_col)
    own = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    clear = F.col(f"`{text_col}`")
    found = docs.select(F.struct(*own).alias("row") if own else F.lit(None).alias("row"), clear.alias("text"), found_spans(F.coalesce(clear.cast("string"), F.lit("")), model).alias("pii"))
    new = redact(F.col("text"), F.col("pii"))
    return found.select(*(new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
