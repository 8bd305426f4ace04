"""URL filter: rules for hosts and paths, and logistic regression on hashed character n-grams for all other URLs.

Only built-in functions touch the URLs. The regression is fitted on the driver, from the n-grams of a small labelled table
that the same functions cut, and reaches the plan as one constant array. The labelled table at hand knows what unwanted
sites are commonly called; names it has nothing in common with are judged by their few known n-grams only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsmith.llm.common import ascii_lower, require

GRAMS, BUCKETS = (3, 4), 8192
#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labelled rows, at most, that a model is fitted on.
MOST_LABELS = 20_000
#: Site names of the labelled table, written down from general knowledge of what such sites are called.
UNWANTED = (
    "poker-bonus", "slots-jackpot", "online-casino-bonus", "roulette-win", "sports-betting-tips", "free-spins", "lottery-winners", "bingo-cash", "diet-pills-shop", "cheap-meds", "viagra-store",
    "weightloss-miracle", "replica-watches", "cheap-handbags", "payday-loans", "fast-cash-now", "debt-free-loans", "crypto-doubler", "forex-profits", "penny-stock-alerts", "work-from-home-cash",
    "hot-singles", "adult-webcams", "xxx-videos", "porn-tube", "sexy-chat", "escort-girls", "nude-cams", "click-tracker", "popup-ads", "adserver-click", "banner-tracking", "spam-mailer", "buy-followers",
    "free-gift-cards", "win-free-phone", "keygen-cracks", "warez-downloads", "free-movie-stream", "virus-alert-scan",
)
WANTED = (
    "city-library", "open-museum", "weather-report", "school-board", "garden-club", "tech-notes", "river-news", "math-forum", "health-council", "travel-diary", "cook-book", "sea-history", "national-archive",
    "daily-herald", "morning-post", "evening-times", "science-review", "physics-letters", "village-church", "county-council", "public-radio", "film-institute", "theatre-guide", "orchestra-hall",
    "book-store", "language-school", "university-press", "student-union", "medical-journal", "animal-rescue", "bird-watchers", "mountain-hikers", "cycling-club", "football-league", "chess-federation",
    "railway-society", "harbour-authority", "water-works", "energy-agency", "housing-trust", "software-foundation", "kernel-docs", "python-tutorial", "database-manual", "map-atlas", "star-gazers",
    "wine-growers", "farm-market", "bakery-recipes", "knitting-patterns", "history-society", "poetry-magazine", "photo-gallery", "law-review", "tax-office", "fire-department", "town-hall", "post-office",
    "art-academy", "music-lessons", "the-thinkers", "other-voices", "north-station", "earth-observer",
)
_HOSTS = ("{}.com", "www.{}.org", "blog.{}.net", "m.{}.info", "{}.co.uk", "shop.{}.de")
_ENDS = ("/", "/en/1", "/index.html", "/about/2020/05", "/news/4444.html", "/p?id=7", "/fr/33/")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, unwanted): every site name under every host pattern, with the ends in turn, joined by hyphens or in one. A few hundred rows."""
    rows = [
        f"{bad} https://{host.format(name if (i + j) % 2 else name.replace('-', ''))}{_ENDS[(i + j) % len(_ENDS)]}"
        for bad, names in ((1, UNWANTED), (0, WANTED)) for i, name in enumerate(names) for j, host in enumerate(_HOSTS)
    ]
    row = F.explode(F.split(F.lit("\n".join(rows)), "\n")).alias("row")
    return spark.range(1).select(row).select(F.substring("row", 3, 1000).alias("url"), F.substring("row", 1, 1).cast("int").alias("unwanted"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def gram_buckets(host: Column, path: Column) -> Column:
    """Buckets of the n-grams of host and path, digits alike; none if both are empty."""

    def grams(mark: str, size: int, c: Column) -> Column:
        text = F.concat(F.lit("^"), F.translate(ascii_lower(c), "123456789", "000000000"), F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - F.lit(size - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(f"{mark}{size}"), F.substring(text, i, F.lit(size))), F.lit(BUCKETS)).cast("int"))

    empty = F.array().cast("array<int>")
    return F.concat(*(F.when(c != "", grams(mark, size, c)).otherwise(empty) for mark, c in (("h", host), ("p", path)) for size in GRAMS))


class UrlModel:
    """Weights by bucket, and a constant. A URL's score is the constant and its n-grams' weights over the root of their number."""

    def __init__(self, weights: np.ndarray, constant: float):
        self.weights, self.constant = weights, constant

    @classmethod
    def fit(cls, labelled: DataFrame, steps: int = 400, rate: float = 1.0, ridge: float = 1e-3) -> UrlModel:
        """From (url, unwanted) by gradient descent, on the driver: of the MOST_LABELS rows of least hash. Rows with nulls are left out."""
        host, path = host_and_path(F.col("url"))
        some = labelled.where("url is not null and unwanted is not null").orderBy(F.xxhash64("url"), "url", "unwanted").limit(MOST_LABELS)
        rows = some.select(gram_buckets(host, path).alias("g"), F.col("unwanted").cast("double").alias("y")).collect()
        x = np.zeros((len(rows), BUCKETS))
        for i, r in enumerate(rows):
            np.add.at(x[i], r["g"], 1 / np.sqrt(max(1, len(r["g"]))))
        y, w, c = np.array([r["y"] for r in rows]), np.zeros(BUCKETS), 0.0
        for _ in range(steps if len(rows) else 0):
            miss = 1 / (1 + np.exp(-(x @ w + c))) - y
            w -= rate * (x.T @ miss / len(y) * 10 + ridge * w)
            c -= rate * miss.mean()
        return cls(w, float(c))

    def score(self, host: Column, path: Column) -> Column:
        """Log-odds that a URL is unwanted; 0 without n-grams."""
        # one foldable text instead of thousands of literals
        weights = F.split(F.lit(",".join(repr(float(v)) for v in self.weights)), ",").cast("array<double>")
        grams = gram_buckets(host, path)
        total = F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.get(weights, b))
        return F.when(F.size(grams) > 0, F.lit(self.constant) + total / F.sqrt(F.size(grams).cast("double"))).otherwise(F.lit(0.0))


def rule_and_verdict(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path together, and its verdict; null if none fits."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """pages(page_id, url) -> (page_id, host, path, rule, verdict, log_odds), a row for each row.

    A null url, or one without "://", has an empty host and path and is allowed. Null page_id and repeated rows stay as
    they are; urls of any length are taken whole; other columns are ignored; an empty table gives no rows. Without labelled
    rows every score is 0, which allows.
    """
    require(pages, "page_id", "url")
    model = UrlModel.fit(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    host, path = host_and_path(F.col("url"))
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_and_verdict(F.col("host"), F.col("path"), rules)
    out = cut.select("*", rule.alias("rule"), verdict.alias("_by_rule"), model.score(F.col("host"), F.col("path")).alias("log_odds"))
    by_model = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_by_rule", by_model).alias("verdict"), "log_odds")
