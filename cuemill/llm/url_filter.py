"""Verdicts on page addresses: rules first, then logistic regression on hashed character n-grams.

Everything is an expression or aggregate of DataFrames. Training is batch
gradient descent inside one row that holds the small labelled table as lists.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.arrays import let
from cuemill.llm.page_text import host_of, path_of

BUCKETS = 4096
STEPS, RATE, DECAY = 150, 8.0, 0.001


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, for paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules that all reports share.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

# The labelled table: addresses made up for training, 1 for those to block.
LABELLED_URLS = (
    ("http://www.casino-royal.test/en/12", 1),
    ("https://online-casino.test/de/bonus", 1),
    ("http://m.casino-jackpot.test/1", 1),
    ("https://www.best-bets.test/fr/tips", 1),
    ("http://bets-today.test/", 1),
    ("https://blog.free-spins.test/es/88", 1),
    ("https://www.cheap-meds.test/buy", 1),
    ("http://pills-online.test/es/order", 1),
    ("http://m.diet-pills.test/en/3", 1),
    ("https://link-farm.test/fr/22", 1),
    ("https://www.spam-mails.test/list", 1),
    ("http://content-farm.test/de/90", 1),
    ("http://www.track-ads.test/click", 1),
    ("https://ads-server.test/fr/5", 1),
    ("http://m.popup-ads.test/en/6", 1),
    ("https://www.adult-cams.test/fr/live", 1),
    ("http://xxx-adult.test/es/2", 1),
    ("https://adult-chat.test/de/9", 1),
    ("http://casino-lucky.test/en/3", 1),
    ("https://my-casino.test/es/wheel", 1),
    ("http://www.casinos.test/fr/1", 1),
    ("https://big-win.test/de/now", 1),
    ("http://winbig.test/en/44", 1),
    ("https://poker-win.test/fr/deal", 1),
    ("http://slots-win.test/es/6", 1),
    ("https://free-poker.test/en/2", 1),
    ("http://free-cash.test/de/13", 1),
    ("https://m.freeporn.test/fr/8", 1),
    ("http://sport-bets.test/en/odds", 1),
    ("https://live-betting.test/es/51", 1),
    ("http://cheap-viagra.test/fr/2", 1),
    ("https://cheap-loans.test/en/70", 1),
    ("http://www.cheaprolex.test/de/5", 1),
    ("https://buy-pills.test/fr/1", 1),
    ("http://sleeping-pills.test/en/9", 1),
    ("https://pill-shop.test/de/33", 1),
    ("http://spam-list.test/fr/4", 1),
    ("https://bulk-spam.test/en/87", 1),
    ("http://spammers.test/de/1", 1),
    ("https://click-farm.test/es/3", 1),
    ("http://like-farm.test/en/19", 1),
    ("https://farm-links.test/fr/6", 1),
    ("http://ads-network.test/de/2", 1),
    ("https://best-ads.test/es/71", 1),
    ("http://adserver.test/en/1", 1),
    ("https://tracker.test/fr/px", 1),
    ("http://pixel-track.test/es/5", 1),
    ("https://click-track.test/en/4", 1),
    ("http://adult-movies.test/en/2", 1),
    ("https://www.adultdating.test/de/11", 1),
    ("http://adults-only.test/es/8", 1),
    ("https://sex-x.test/fr/9", 1),
    ("http://x-videos.test/en/3", 1),
    ("https://hot-x.test/de/12", 1),
    ("http://www.city-library.test/en/12", 0),
    ("https://blog.garden-notes.test/de/31", 0),
    ("https://weather.test/fr/today", 0),
    ("http://m.train-times.test/es/4", 0),
    ("https://www.school-news.test/en/88", 0),
    ("http://museum.test/en/visit", 0),
    ("https://recipes.test/fr/825", 0),
    ("https://www.the-river.test/en/25", 0),
    ("http://blog.another-day.test/es/533", 0),
    ("https://theory.test/en/685", 0),
    ("https://mathematics.test/en/770", 0),
    ("http://www.athletics.test/de/612", 0),
    ("https://thread.test/fr/10", 0),
    ("https://m.nation.test/en/474", 0),
    ("http://blog.station.test/de/180", 0),
    ("https://www.history.test/en/148", 0),
    ("http://together.test/en/334", 0),
    ("https://lyrics.test/es/978", 0),
    ("https://www.sheet-music.test/en/27", 0),
    ("http://table-tennis.test/fr/414", 0),
    ("https://other-things.test/en/960", 0),
    ("http://www.thinking.test/en/9", 0),
    ("https://blog.rebuild.test/en/853", 0),
    ("http://mountains.test/de/252", 0),
    ("http://catalogue.test/en/31", 0),
    ("http://freedom-archive.test/de/8", 0),
    ("https://better-health.test/en/64", 0),
    ("https://education.test/es/61", 0),
    ("http://chess-club.test/en/500", 0),
    ("https://www.poems.test/fr/81", 0),
    ("http://mythology.test/fr/7", 0),
    ("https://the-fourth-month.test/en/51", 0),
    ("http://width-and-height.test/de/4", 0),
    ("https://north-theatre.test/es/18", 0),
    ("http://thatched-houses.test/en/6", 0),
    ("https://growth-of-cities.test/fr/35", 0),
    ("http://both-banks.test/de/72", 0),
    ("https://truth-and-method.test/en/28", 0),
)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table as (url, blocked)."""
    rows = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(float(y)).alias("blocked")) for u, y in LABELLED_URLS])
    return spark.range(1).select(F.inline(rows))


def _grams(text: Column, size: int, salt: int) -> Column:
    """Buckets of the ``size``-grams of a text."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))

    def bucket(c: Column, k: Column) -> Column:
        # sums of character codes by odd factors
        total = F.lit(salt)
        for j, factor in enumerate((7919, 104729, 1299709, 15485863)[:size]):
            total = total + F.get(c, k + j) * factor
        return F.pmod(total, F.lit(BUCKETS)).cast("int")

    places = F.when(F.length(text) >= size, F.sequence(F.lit(0), F.length(text) - size)).otherwise(
        F.array().cast("array<int>")
    )
    return let(codes, lambda c: F.transform(places, lambda k: bucket(c, k)))


def url_features(host: Column, path: Column) -> Column:
    """Distinct buckets of the 3- and 4-grams of host and path, each with its ends marked."""
    marked_host, marked_path = F.concat(F.lit("^"), host, F.lit("$")), F.concat(path, F.lit("$"))
    parts = [_grams(marked_host, 3, 1), _grams(marked_host, 4, 2), _grams(marked_path, 3, 3), _grams(marked_path, 4, 4)]
    return F.array_distinct(F.concat(*parts))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _margin(weights: Column, features: Column) -> Column:
    """Bias and the mean-square scaled sum of the weights of the features."""
    total = F.aggregate(features, F.lit(0.0), lambda a, b: a + F.get(weights, b))
    return F.get(weights, F.lit(BUCKETS)) + total / F.sqrt(F.greatest(F.size(features), F.lit(1)))


def learn_url_weights(labelled: DataFrame) -> list[float]:
    """Weights of the buckets and, last, the bias, from a small table (url, blocked 0 or 1).

    The table is held in one row, so it must be small, thousands of addresses at
    most; rows without url or label are left out. Without rows all weights are 0.
    """
    rows = labelled.filter("url is not null and blocked is not null")
    rows = rows.select(
        url_features(host_of(F.col("url")), path_of(F.col("url"))).alias("f"), F.col("blocked").cast("double").alias("y")
    )
    whole = rows.agg(F.array_sort(F.collect_list(F.struct("f", "y"))).alias("rows"))
    # for every bucket the rows that have it, and what they count
    entries = whole.select("rows", F.posexplode("rows").alias("i", "row")).select(
        "i", (1 / F.sqrt(F.greatest(F.size("row.f"), F.lit(1)))).alias("v"), F.explode("row.f").alias("b")
    )
    held = entries.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("rows_with"))
    every = held.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("b", "rows_with")))).alias("by_bucket"))
    buckets = F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)),
        lambda b: F.coalesce(F.element_at("by_bucket", b), F.array().cast("array<struct<i: int, v: double>>")),
    )
    table = whole.crossJoin(every).select("rows", buckets.alias("buckets"))

    n = F.greatest(F.size("rows"), F.lit(1))

    def step(w: Column) -> Column:
        errors = F.transform("rows", lambda r: _sigmoid(_margin(w, r["f"])) - r["y"])

        def moved(e: Column) -> Column:
            pulls = F.transform("buckets", lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + F.get(e, x["i"]) * x["v"]))
            slope = F.concat(pulls, F.array(F.aggregate(e, F.lit(0.0), lambda a, x: a + x)))
            return F.zip_with(w, slope, lambda a, g: a - (g / n + a * DECAY) * RATE)

        return let(errors, moved)

    start = F.array_repeat(F.lit(0.0), BUCKETS + 1)
    weights = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda w, _: step(w))
    return list(table.select(weights.alias("w")).first()["w"])


def judge_urls(pages: DataFrame, weights: Sequence[float], rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of web pages (page_id, url), a row for each row.

    The longest rule that fits decides: its host is the page's or one above it,
    and the path begins with the rule's. Else the page is blocked if the model's
    score, a probability, is 0.5 or more; ``rule`` is then null. A null url, or
    one without ``://``, has an empty host and path and is scored so. The
    library's own records have no addresses, so this is for any table of them.
    """
    held = F.array(*[F.lit(float(w)) for w in weights])
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        below = (F.col("host") == r.host) | F.col("host").endswith("." + r.host)
        fits = below & F.col("path").startswith(r.path)
        rule = F.when(fits, F.lit(r.name)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    score = _sigmoid(_margin(held, url_features(F.col("host"), F.col("path"))))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), score.alias("score"))
    judged = F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", judged.alias("verdict"), "score")
