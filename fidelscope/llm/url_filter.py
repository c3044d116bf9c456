"""URL filter by a ratio of character language models (operator 1), native.

Rules decide what they can.  The URLs they allow and block are the training text of two smoothed
variable-order Markov models over characters, which judge all other URLs: by the difference of
the two log likelihoods per character, against a threshold calibrated on URLs set aside.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fidelscope.llm.common import join_by_key, lower_ascii
from fidelscope.session import stage

#: (host, path prefix, verdict): a host stands for itself and its subdomains.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
ORDER = 4
#: Characters outside the training text share this many places in the uniform start.
ALPHABET = 256
#: One URL in so many that a rule decides calibrates the threshold and trains nothing.
CALIBRATION = 5
START = "\u0002"
CLASSES = ("allow", "block")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as a struct of ``rule`` and ``verdict``, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(prefix))
        found = F.when(
            fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        ).otherwise(found)
    return found


def grams(url: Column, order: int = ORDER) -> Column:
    """For each character, itself with the ``order`` characters before it."""
    padded = F.concat(F.lit(START * order), url)
    # A sequence from 1 to 0 would count down.
    places = F.sequence(F.lit(1), F.greatest(F.length(url), F.lit(1)))
    found = F.transform(places, lambda i: F.substr(padded, i, F.lit(order + 1)))
    return F.when(F.length(url) > 0, found).otherwise(F.array().cast("array<string>"))


def train(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """Log-likelihood difference of each gram, from its counts in the two classes.

    ``counted`` has ``gram, allow, block``: one row for each gram to judge, with counts that may
    be 0.  Each order is interpolated with the next shorter one by Witten-Bell weights, so that
    an unseen context leaves the shorter one's probability as it is.
    """
    shorter = None
    for k in range(order + 1):
        name = F.right("gram", F.lit(k + 1))
        level = counted.groupBy(name.alias("gram")).agg(*(F.sum(c).alias(c) for c in CLASSES))
        context = F.left("gram", F.lit(k))
        # Below order 1 the context is empty: one group, of distinct characters only.
        stats = level.groupBy(context.alias("context")).agg(
            *(F.sum(c).alias(f"n_{c}") for c in CLASSES),
            *(F.sum((F.col(c) > 0).cast("long")).alias(f"t_{c}") for c in CLASSES),
        )
        level = level.withColumn("context", context).join(stats, "context")
        if shorter is None:
            base = {c: F.lit(1.0 / ALPHABET) for c in CLASSES}
        else:
            level = level.withColumn("suffix", F.right("gram", F.lit(k))).join(
                shorter.withColumnRenamed("gram", "suffix"), "suffix"
            )
            base = {c: F.col(f"p_{c}") for c in CLASSES}
        weighed = {
            c: F.when(
                F.col(f"n_{c}") > 0,
                (F.col(c) + F.col(f"t_{c}") * base[c]) / (F.col(f"n_{c}") + F.col(f"t_{c}")),
            ).otherwise(base[c])
            for c in CLASSES
        }
        shorter = level.select("gram", *(v.alias(f"p_{c}") for c, v in weighed.items()))
        shorter = stage(shorter) if k in (2, order - 1) else shorter
    ratio = F.log("p_allow") - F.log("p_block")
    return shorter.select("gram", F.round(ratio, 9).alias("ratio"))


def score(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """``row, score`` for all rows of ``urls``, a staged frame with ``row, url, trains``.

    ``trains`` is the class of a training URL, else null.  The score is the log-likelihood
    difference per character; a URL without characters has none and gets 0.
    """
    places = urls.select("row", "trains", F.explode(grams(F.col("url"), order)).alias("gram"))
    counted = stage(
        places.groupBy("gram").agg(
            *(F.sum((F.col("trains") == c).cast("long")).alias(c) for c in CLASSES),
            F.count("*").alias("n"),
        ).fillna(0, list(CLASSES))
    )
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ratios = stage(train(counted, order).join(counted.select("gram", "n"), "gram"))
    lines = join_by_key(places.drop("trains"), ratios, "gram", "n", total)
    sums = lines.groupBy("row").agg(
        F.sum(F.col("ratio").cast("decimal(30,9)")).cast("double").alias("sum"), F.count("*").alias("n")
    )
    return sums.select("row", (F.col("sum") / F.col("n")).alias("score"))


def threshold(scored: DataFrame) -> float:
    """The cut with the best mean of the two recalls on calibration URLs (``score, class``).

    Scores are binned to hundredths; of equally good cuts the one nearest 0 is taken, and 0 if
    a class has no URL.
    """
    bins = scored.groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(
        *(F.sum((F.col("class") == c).cast("long")).alias(c) for c in CLASSES)
    )
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    lost = F.coalesce(F.sum("allow").over(below), F.lit(0)) / F.sum("allow").over(everything)
    caught = F.coalesce(F.sum("block").over(below), F.lit(0)) / F.sum("block").over(everything)
    best = (
        bins.select("bin", (caught - lost).alias("gain")).where("gain > 0")
        .orderBy(F.desc("gain"), F.abs("bin"), "bin").limit(1).collect()
    )
    return best[0]["bin"] / 100 if best else 0.0


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, order: int = ORDER
) -> DataFrame:
    """A verdict for every page, from its URL alone.

    Returns ``page_id, host, path, rule, verdict, score``; other columns of ``pages`` are not
    read.  Rows with the same page_id are judged one by one.

    * A null URL, or one without ``://``, has an empty host and path, so no rule fits it; the
      models judge its characters all the same.  A URL without characters has the score 0.
    * If the rules give no training URL for a class, that model is uniform.
    * Scores of at least the threshold are allowed, ties included.
    """
    host, path = host_and_path(F.col("url"))
    rows = stage(
        pages.select("page_id", "url", F.monotonically_increasing_id().alias("row"))
        .withColumns({"host": host, "path": path})
        .withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
        .withColumns({
            "url": F.coalesce("url", F.lit("")), "class": F.col("found.verdict"),
            "calibrates": F.crc32(F.coalesce("url", F.lit("")).cast("binary")) % CALIBRATION == 0,
        })
    )
    urls = rows.select("row", "url", F.when(~F.col("calibrates"), F.col("class")).alias("trains"))
    scores = stage(rows.join(score(urls, order), "row", "left").fillna(0.0, ["score"]))
    cut = threshold(scores.where("class IS NOT NULL AND calibrates"))
    by_model = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return scores.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("class", by_model).alias("verdict"), "score",
    )
