"""URL filter: allow and block rules, and a character language-model ratio for the rest.

The urls that a rule allows or blocks train two character models (accepted, rejected) of
variable order: contexts of 0 to ``ORDER`` characters, Witten-Bell interpolated down to a uniform
distribution. A url's score is the difference of its log-likelihoods under the two, divided by its
length. A fifth of the labelled urls, chosen by hash, is held out of training; the threshold is
the score below which ``ALPHA`` of the accepted ones among them fall. Urls without a rule are blocked
below it.

Counts are over all distinct labelled urls and grow with them. Per position the longest known
n-gram gives the logarithm of the ratio, each longer known context its back-off weight; both come
from equality joins with the distinct n-grams of all urls. Their results go to the positions in one
more join: broadcast while they are at most ``BROADCAST_ROWS`` rows (counted), shuffled beyond
that, where Spark splits the frequent n-grams. Everything is native.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule, and is
scored by its text (a null or empty one scores 0); without labelled urls of both kinds no url
is blocked by score; repeated rows stay, one to one.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from barlume.llm.common import materialize

#: (rule, verdict); fixed values of the contract.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
ORDER = 4
ALPHA = 0.02
HELD_OUT = 5  # one in so many labelled urls calibrates
ALPHABET = 256
BROADCAST_ROWS = 200_000
_PAD, _STOP = "\x02", "\x03"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.position(F.lit("://"), url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(url)), r"^[^?#]*", 0), F.lit(""))
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, tail = rule.partition("/")
        on_host = (host == name) | F.endswith(host, F.lit("." + name))
        fits.append(F.when(on_host & F.startswith(path, F.lit(slash + tail)), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def _positions(urls: DataFrame, *columns: str) -> DataFrame:
    """A row per character (and one for the end): c0..cK the contexts before it, ch the character."""
    padded = F.concat(F.lit(_PAD * ORDER), F.col("text"), F.lit(_STOP))
    rows = urls.select(*columns, padded.alias("t"), F.explode(F.sequence(F.lit(ORDER + 1), F.length("text") + ORDER + 1)).alias("i"))
    return rows.select(*columns, *(F.substring("t", F.col("i") - k, F.lit(k)).alias(f"c{k}") for k in range(ORDER + 1)), F.substring("t", F.col("i"), F.lit(1)).alias("ch"))


def train(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (text, accepted boolean): grams (ord, ctx, ch, ratio, p1, p0) and contexts (ord, ctx, back)."""
    at = _positions(urls, "accepted")
    by_order = F.explode(F.array(*(F.struct(F.lit(k).alias("ord"), F.col(f"c{k}").alias("ctx")) for k in range(ORDER + 1)))).alias("g")
    counted = materialize(
        at.select("accepted", "ch", by_order).groupBy(F.col("g.ord").alias("ord"), F.col("g.ctx").alias("ctx"), "ch").agg(F.count_if("accepted").alias("n1"), F.count_if(~F.col("accepted")).alias("n0")),
        "url-grams",
    )
    totals = counted.groupBy("ord", "ctx").agg(
        F.sum("n1").alias("t1"), F.sum("n0").alias("t0"), F.count_if(F.col("n1") > 0).alias("d1"), F.count_if(F.col("n0") > 0).alias("d0")
    )
    escape = lambda y: F.when(F.col(f"t{y}") > 0, F.col(f"d{y}") / (F.col(f"t{y}") + F.col(f"d{y}"))).otherwise(F.lit(1.0))
    contexts = materialize(totals.select("ord", "ctx", "t1", "t0", "d1", "d0", (F.log(escape(1)) - F.log(escape(0))).alias("back")), "url-contexts")
    grams, below = [], None
    for k in range(ORDER + 1):
        rows = counted.where(F.col("ord") == k).join(contexts.where(F.col("ord") == k).drop("ord"), "ctx")
        if below is None:
            rows = rows.withColumns({"q1": F.lit(1 / ALPHABET), "q0": F.lit(1 / ALPHABET)})
        else:
            lower = below.select(F.col("ctx").alias("shorter"), "ch", F.col("p1").alias("q1"), F.col("p0").alias("q0"))
            rows = rows.withColumn("shorter", F.substring("ctx", F.lit(2), F.lit(ORDER))).join(lower, ["shorter", "ch"])
        p = {y: F.when(F.col(f"t{y}") > 0, (F.col(f"n{y}") + F.col(f"d{y}") * F.col(f"q{y}")) / (F.col(f"t{y}") + F.col(f"d{y}"))).otherwise(F.col(f"q{y}")) for y in (1, 0)}
        below = materialize(rows.select("ord", "ctx", "ch", p[1].alias("p1"), p[0].alias("p0")), "url-model")
        grams.append(below)
    table = reduce(DataFrame.unionByName, grams)
    return table.select("ord", "ctx", "ch", (F.log("p1") - F.log("p0")).alias("ratio"), "p1", "p0"), contexts.select("ord", "ctx", "back")


def ratios(needed: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """(g, at): the log ratio of each distinct stretch of ``ORDER`` characters and the one that follows."""
    last = ORDER + 1
    rows = needed.select("g", F.substring("g", F.lit(last), F.lit(1)).alias("ch"), *(F.substring("g", F.lit(last - k), F.lit(k)).alias(f"c{k}") for k in range(last)))
    for k in range(last):
        g = grams.where(F.col("ord") == k).select(F.col("ctx").alias(f"c{k}"), "ch", F.col("ratio").alias(f"r{k}"))
        rows = rows.join(g, [f"c{k}", "ch"], "left")
        if k:
            c = contexts.where(F.col("ord") == k).select(F.col("ctx").alias(f"c{k}"), F.col("back").alias(f"b{k}"))
            rows = rows.join(c, f"c{k}", "left")
    at = F.coalesce("r0", F.lit(0.0))  # a character never seen tells nothing
    for k in range(1, last):
        at = F.when(F.col(f"r{k}").isNotNull(), F.col(f"r{k}")).otherwise(at + F.coalesce(f"b{k}", F.lit(0.0)))
    return rows.select("g", at.alias("at"))


def score(urls: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """(url, score): the log-likelihood difference per character of each distinct url's text.

    What a position adds depends on its last ``ORDER`` + 1 characters only, so the model is joined to the
    distinct ones of all urls, and their results, once, to the positions."""
    padded = F.concat(F.lit(_PAD * ORDER), F.col("text"), F.lit(_STOP))
    rows = urls.select("url", padded.alias("t"), F.explode(F.sequence(F.lit(1), F.length("text") + 1)).alias("i"))
    rows = rows.select("url", F.substring("t", F.col("i"), F.lit(ORDER + 1)).alias("g"))
    found = materialize(ratios(materialize(rows.select("g").distinct(), "url-needed"), grams, contexts), "url-ratios")
    small = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return rows.join(small, "g").groupBy("url").agg(F.round(F.avg("at"), 9).alias("score"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, alpha: float = ALPHA) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, threshold) of every row of ``pages``."""
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    # a url's text: host and path, or the whole where there is no ://
    text = F.when(F.position(F.lit("://"), F.col("url")) > 0, F.concat(host, path)).otherwise(F.col("url"))
    known = rows.where(F.col("url").isNotNull()).select("url").distinct()
    known = known.select("url", text.alias("text"), rule_for(host, path, rules).alias("fit"), (F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0).alias("held"))
    known = materialize(known.select("url", "text", (F.col("fit.verdict") == "allow").alias("accepted"), "held"), "url-known")
    learn = known.where(F.col("accepted").isNotNull() & ~F.col("held"))
    both = learn.agg(F.count_if("accepted"), F.count_if(~F.col("accepted"))).first()
    if both[0] and both[1]:
        scored = materialize(score(known, *train(learn.select("text", "accepted"))), "url-scores")
        sure = scored.join(known.where(F.col("accepted") & F.col("held")).select("url"), "url", "left_semi")
        threshold = sure.agg(F.percentile_approx("score", F.lit(alpha), F.lit(100_000))).first()[0]
    else:
        scored, threshold = known.select("url", F.lit(0.0).alias("score")), None
    bound = F.lit(threshold).cast("double")
    out = rows.join(scored, "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    out = out.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))}).withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") < bound, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score", bound.alias("threshold"))
