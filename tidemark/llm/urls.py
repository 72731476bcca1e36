"""URL filters: host and path rules first, then a character language model for URLs without a rule.

Two models of characters, one of accepted and one of rejected URLs, are learnt from the URLs that rules decide. Each
predicts a character from the two before it, backing off to one and to none as contexts get rarer (Witten-Bell). A URL's
score is the difference of its log-likelihoods under the two, divided by its length. Models are fitted on the URLs of
four fifths of the hosts; on those of the last fifth the cut is calibrated, the one that best separates the two kinds.

DataFrame operations only. The alphabet has ``len(ALPHABET)`` characters, others fold to one, so there are at most its
third power of trigrams, whatever the input: tables of trigrams are joined by broadcast under that bound. URLs are
counted before they are cut into trigrams, so a frequent URL is scored once.

Nulls and ties: a URL that is null or has no ``://`` has the empty host and path; without a scheme the model reads the
whole URL, null as empty. Of rules that fit, the longest wins, of equal ones the first given. If rules decide no URL, or
all one way, there is no model and the verdict is allow. A score equal to the cut is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.staging import stage

ALLOW, BLOCK = "allow", "block"
#: (verdict, host and path), the path from the first slash on.
RULES = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))

EDGE = "^"
DIGITS = "0123456789"
ALPHABET = EDGE + "abcdefghijklmnopqrstuvwxyz0./-_?=&:%#~"
FOLDED = "~"
ORDER = 3
FOLDS = 5
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def behind_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(behind_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _CAPITALS, _CAPITALS.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(behind_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """(verdict, rule) of the longest rule that fits; null if none does."""
    chosen = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1]))[::-1]:
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rest))
        chosen = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(chosen)
    return chosen


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule struct)."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return rows.withColumn("decided", rule_for(F.col("host"), F.col("path"), rules))


def folded(url: Column) -> Column:
    """The URL in the models' alphabet, with an edge mark at either end (two in front)."""
    text = F.lower(F.coalesce(behind_scheme(url), url, F.lit("")))
    text = F.translate(text, DIGITS, "0" * len(DIGITS))
    return F.concat(F.lit(EDGE * (ORDER - 1)), F.regexp_replace(text, r"[^a-z0./_?=&:%#-]", FOLDED), F.lit(EDGE))


def _grams(urls: DataFrame) -> DataFrame:
    """A row for each distinct trigram of a row of ``urls(key, text, ...)``, with how often it occurs there."""
    places = F.sequence(F.lit(1), F.length("text") - (ORDER - 1))
    return urls.withColumn("gram", F.explode(F.transform(places, lambda at: F.substring(F.col("text"), at, F.lit(ORDER)))))


def _log_probabilities(counts: DataFrame, grams: DataFrame, side: str) -> DataFrame:
    """(gram, log): log-probability of the trigram's last character, from trigram ``counts(gram, n)``; all tables are bounded
    by the alphabet."""
    orders = {}
    for order in range(1, ORDER + 1):
        tail = F.substring("gram", ORDER - order + 1, order)
        by = counts.groupBy(tail.alias(f"g{order}")).agg(F.sum("n").alias(f"n{order}"))
        context = F.substring(f"g{order}", 1, order - 1)
        seen = by.groupBy(context.alias(f"c{order}")).agg(F.sum(f"n{order}").alias(f"of{order}"), F.count("*").alias(f"kinds{order}"))
        orders[order] = by, seen
    out = grams.select("gram")
    probability = F.lit(1.0 / len(ALPHABET))
    for order, (by, seen) in orders.items():
        tail = F.substring("gram", ORDER - order + 1, order)
        out = out.withColumns({f"g{order}": tail, f"c{order}": F.substring("gram", ORDER - order + 1, order - 1)})
        out = out.join(F.broadcast(by), f"g{order}", "left").join(F.broadcast(seen), f"c{order}", "left")
        n, of, kinds = F.coalesce(f"n{order}", F.lit(0)), F.col(f"of{order}"), F.col(f"kinds{order}")
        probability = F.when(of.isNull(), probability).otherwise((n + kinds * probability) / (of + kinds))
    return out.select("gram", F.log(probability).alias(side))


def weights(urls: DataFrame) -> DataFrame:
    """(gram, weight): log-likelihood ratio, accepted over rejected, of each trigram in ``urls(text, n, verdict, fold)``."""
    cut = _grams(urls)
    learnt = cut.filter(F.col("verdict").isNotNull() & (F.col("fold") > 0)).groupBy("verdict", "gram").agg(F.sum("n").alias("n"))
    learnt = stage(learnt, "url-counts")
    grams = stage(cut.select("gram").distinct(), "url-grams")
    sides = [_log_probabilities(learnt.filter(F.col("verdict") == v).select("gram", "n"), grams, v) for v in (ALLOW, BLOCK)]
    both = sides[0].join(F.broadcast(sides[1]), "gram")
    return stage(both.select("gram", (F.col(ALLOW) - F.col(BLOCK)).alias("weight")), "url-weights")


def scored(urls: DataFrame, weights: DataFrame) -> DataFrame:
    """``urls`` with ``score``, the mean weight of their trigrams."""
    keys = ("url", "n", "verdict", "fold")
    cut = _grams(urls).join(F.broadcast(weights), "gram")
    return cut.groupBy(*keys).agg(F.round(F.avg("weight"), 9).alias("score"))


def calibrated_cut(scores: DataFrame) -> float | None:
    """The score from which URLs are allowed: of the cuts at hundredths, the one with the largest sum of the shares decided rightly
    of either kind, the lowest of equals; null without both kinds."""
    bins = F.floor(F.col("score") * 100)
    table = scores.filter(F.col("verdict").isNotNull() & (F.col("fold") == 0)).groupBy(bins.alias("bin"))
    good, bad = (F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in (ALLOW, BLOCK))
    rows = sorted(table.agg(good, bad).collect(), key=lambda r: r["bin"])  # some hundred rows: scores are bounded by the smoothing
    allowed, blocked = sum(r[ALLOW] for r in rows), sum(r[BLOCK] for r in rows)
    if not allowed or not blocked:
        return None
    best, cut, kept, dropped = 1.0, rows[0]["bin"], allowed, 0
    for row in rows:
        kept, dropped = kept - row[ALLOW], dropped + row[BLOCK]
        if (gain := kept / allowed + dropped / blocked) > best:
            best, cut = gain, row["bin"] + 1
    return cut / 100


def verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each page; the score is the model's, null without a model.

    There is a model where rules allow some URLs and block others. It learns from all folds but the calibration fold; if these
    lack a kind, from all of them. If the calibration fold lacks a kind, or was learnt from, nothing is left to calibrate
    with, and the cut is where both models find a URL equally likely, at 0.
    """
    rows = judged(pages, rules)
    known = rows.groupBy("url").agg(F.count("*").alias("n"), F.first("decided.verdict").alias("verdict"), F.first("host").alias("host"))
    fold = F.conv(F.substring(F.md5("host"), 1, 8), 16, 10).cast("long") % FOLDS
    urls = stage(known.select("url", "n", "verdict", fold.alias("fold"), folded(F.col("url")).alias("text")), "urls")
    told = urls.filter("verdict IS NOT NULL").select("verdict", (F.col("fold") > 0).alias("learnt")).distinct()
    kinds = {(r["verdict"], r["learnt"]) for r in told.collect()}  # four at most
    if {verdict for verdict, _ in kinds} < {ALLOW, BLOCK}:
        cut, scores = None, urls.select("url", F.lit(None).cast("double").alias("score"))
    else:
        if not {(ALLOW, True), (BLOCK, True)} <= kinds:
            urls = urls.withColumn("fold", F.lit(1).cast("long"))
        scores = stage(scored(urls, weights(urls)), "url-scores")
        cut = calibrated_cut(scores)
        cut = 0.0 if cut is None else cut
    found = scores.select(F.col("url").alias("of"), "score")
    model = F.lit(ALLOW) if cut is None else F.when(F.col("score") >= cut, ALLOW).otherwise(BLOCK)
    joined = rows.join(found, rows["url"].eqNullSafe(found["of"]), "left")
    return joined.select(
        "page_id", "host", "path", F.col("decided.rule").alias("rule"), F.coalesce("decided.verdict", model).alias("verdict"), "score"
    )
