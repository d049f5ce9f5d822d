"""URL filter: listed rules first, a character language-model ratio for all other urls.

Two variable-order Markov models of characters are learned from the urls that rules accept or reject, one each. A
character's probability is interpolated from order 0 up to the longest context seen (`ORDER` at most) with Witten-Bell
weights: N(context) observations against T(context) distinct followers. A url's score is the difference of both
log-likelihoods per character; a logistic curve fitted on hosts set aside turns it into the probability of rejection.

* Urls are modelled as host + path with every run of digits as one 0, so that ids teach nothing. Equal forms are counted
  once with their number of pages, and scored once: the work follows distinct forms, not pages, and no page or host is
  a hot key of the counting. Counts cover all ruled pages of the training hosts.
* Contexts are a table that grows with the input and is joined, not broadcast. Only the calibration leaves the
  executors: counts on a fixed grid of `GRID` steps on each side of zero.

Nulls and odd rows: a null url, or one without `://`, has an empty host and path, fits no rule and is scored like any
other. If no ruled url is accepted or none is rejected, the others are allowed. If the hosts set aside are all of one
kind, the uncalibrated score decides. Null page_ids and repeated rows are carried along. An empty table gives an empty
result. Only page_id and url are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lictor.llm.tables import stored

#: (verdict, host, path); a rule fits its host and all subdomains if the path starts with the rule's. The longest wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER, ALPHABET, GRID, STEP = 5, 256, 2000, 0.01
#: One host in FOLDS is set aside for the calibration.
FOLDS = 5


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, both empty without `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule (host and path of the longest that fits) and ruled (its verdict)."""
    host, path = parts(F.col("url"))
    rows = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("ruled", verdict)


def _form() -> Column:
    return F.regexp_replace(F.concat("host", "path"), r"[0-9]+", "0")


def _characters(forms: DataFrame, *keep: str) -> DataFrame:
    """One row per form, place and order: k, context, c. A form begins with \x02 and ends with \x03."""
    text = F.concat(F.lit("\x02"), F.col("form"), F.lit("\x03"))
    placed = forms.select(*keep, text.alias("t")).withColumn("at", F.explode(F.sequence(F.lit(2), F.length("t"))))
    orders = F.explode(F.sequence(F.lit(0), F.least(F.lit(ORDER), F.col("at") - 1)))
    placed = placed.withColumn("k", orders)
    return placed.select(*keep, "at", "k", F.substring("t", F.col("at") - F.col("k"), F.col("k")).alias("context"), F.substring("t", F.col("at"), F.lit(1)).alias("c"))


def contexts(forms: DataFrame) -> DataFrame:
    """(k, context) -> for accepted (a) and rejected (r) forms: n observations, t followers, and the followers' counts."""
    counts = _characters(forms, "accepted", "rejected").groupBy("k", "context", "c").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
    followers = F.map_from_entries(F.collect_list(F.struct("c", F.struct("a", "r"))))  # at most one entry per character
    return counts.groupBy("k", "context").agg(
        F.sum("a").alias("n_a"), F.sum("r").alias("n_r"), F.count(F.when(F.col("a") > 0, 1)).alias("t_a"), F.count(F.when(F.col("r") > 0, 1)).alias("t_r"),
        followers.alias("followers"))


def ratios(forms: DataFrame, learned: DataFrame) -> DataFrame:
    """form -> ratio: (log-likelihood as rejected - as accepted) per character."""
    seen = _characters(forms, "form").join(learned, ["k", "context"], "left")
    count = F.try_element_at("followers", F.col("c"))
    fields = F.struct(
        "k", *[F.coalesce(x, F.lit(0)).alias(n) for n, x in (("c_a", count["a"]), ("c_r", count["r"]), ("n_a", F.col("n_a")), ("n_r", F.col("n_r")), ("t_a", F.col("t_a")), ("t_r", F.col("t_r")))])
    by_place = seen.groupBy("form", "at").agg(F.sort_array(F.collect_list(fields)).alias("orders"))  # at most ORDER + 1 rows

    def log_probability(of: str) -> Column:
        def longer(p: Column, o: Column) -> Column:
            n, t = o[f"n_{of}"], o[f"t_{of}"]
            return F.when(n > 0, (o[f"c_{of}"] + t * p) / (n + t)).otherwise(p)

        return F.log(F.aggregate("orders", F.lit(1.0 / ALPHABET), longer))

    per_place = by_place.select("form", "at", log_probability("a").alias("a"), log_probability("r").alias("r"))
    # Sums over whole numbers do not depend on their order.
    exact = F.round((F.col("r") - F.col("a")) * 1e9).cast("long")
    return per_place.groupBy("form").agg((F.sum(exact) / F.count("*") / 1e9).alias("ratio"))


def calibration(scored: DataFrame) -> tuple[float, float]:
    """Slope and offset of a logistic curve for the probability of rejection, from (ratio, accepted, rejected) rows."""
    step = F.greatest(F.lit(-GRID), F.least(F.lit(GRID), F.round(F.col("ratio") / STEP).cast("int")))
    rows = scored.groupBy(step.alias("step")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).orderBy("step").collect()
    x = np.array([r.step * STEP for r in rows])
    a, r = np.array([float(r.a) for r in rows]), np.array([float(r.r) for r in rows])
    if not a.sum() or not r.sum():
        return 1.0, 0.0
    high, low = (r.sum() + 1) / (r.sum() + 2), 1 / (a.sum() + 2)  # Platt's targets
    w = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (r * (p - high) + a * (p - low)) + 1e-3 * w
        curve = (design * ((a + r) * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        change = np.linalg.solve(curve, slope)
        w = w - change
        if np.abs(change).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict, and for urls without a rule ratio and p_block."""
    rows = ruled(pages.select("page_id", "url"), rules).withColumn("form", _form())
    kinds = [F.sum(F.when(F.col("ruled") == v, 1).otherwise(0)).alias(n) for v, n in (("allow", "accepted"), ("block", "rejected"))]
    forms = stored(rows.groupBy("form", "host").agg(*kinds, F.count(F.when(F.col("ruled").isNull(), 1)).alias("open")))
    aside = F.pmod(F.crc32(F.encode("host", "UTF-8")), F.lit(FOLDS)) == 0
    known = forms.where("accepted > 0 OR rejected > 0")
    learned = stored(contexts(known.where(~aside)))
    wanted = forms.where(aside | (F.col("open") > 0)).groupBy("form").agg(
        F.sum(F.when(aside, F.col("accepted")).otherwise(0)).alias("accepted"), F.sum(F.when(aside, F.col("rejected")).otherwise(0)).alias("rejected"))
    scored = stored(ratios(wanted, learned).join(wanted, "form"))
    both = learned.where("k = 0").agg(F.sum("n_a"), F.sum("n_r")).first()
    slope, offset = calibration(scored)
    p_block = 1 / (1 + F.exp(-(slope * F.col("ratio") + offset))) if all(both) else F.lit(0.0)
    out = rows.join(scored.select("form", "ratio", p_block.alias("p_block")), "form", "left")
    open_url = F.col("ruled").isNull()
    verdict = F.coalesce("ruled", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"),
                      F.when(open_url, F.col("ratio")).alias("ratio"), F.when(open_url, F.col("p_block")).alias("p_block"))
