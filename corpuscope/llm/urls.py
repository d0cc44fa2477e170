"""URL filter: rules by host and path, and a logistic regression on hashed character n-grams for all other URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.tables import ascii_lower, col, fresh

# Buckets that n-grams are hashed to.
BUCKETS = 1 << 13
GRAMS = (3, 4, 5)
# A URL is blocked at this probability.
BLOCK = 0.5

# Rules as (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

# Small labelled table, written from what such addresses look like in general: URLs to block (1) and to keep (0).
LABELLED = (
    ("https://www.cheap-pills-store.net/en/5102", 1),
    ("http://discount-pharmacy-rx.com/de/88", 1),
    ("https://buy-cheap-meds.org/pills/no-prescription", 1),
    ("http://weight-loss-miracle-pills.com/buy", 1),
    ("http://link-farm-directory.net/en/20", 1),
    ("https://seo-spam-links.com/buy-backlinks", 1),
    ("http://spam-farm-pages.info/fr/1130.html", 1),
    ("https://spammy-link-exchange.biz/es/9", 1),
    ("http://free-casino-slots.com/en/77", 1),
    ("https://casino-bonus-online.net/free-spins", 1),
    ("http://online-poker-jackpot.org/es/72", 1),
    ("https://bet-win-casino.com/fr/301", 1),
    ("http://xxx-adult-videos.com/free-porn", 1),
    ("https://adult-webcams-live.net/en/640", 1),
    ("http://hot-sex-tube.org/watch-free", 1),
    ("https://porn-xxx-free.com/es/15.html", 1),
    ("http://replica-watches-cheap.net/rolex-replica", 1),
    ("https://cheap-replica-handbags.com/en/2009", 1),
    ("http://payday-loans-fast-cash.com/en/4", 1),
    ("https://easy-cash-payday-loan.net/no-credit-check", 1),
    ("http://make-money-fast-online.org/get-rich", 1),
    ("https://get-rich-quick-crypto.com/de/51", 1),
    ("http://crypto-giveaway-claim.net/claim-free", 1),
    ("http://free-download-cracked-keygen.com/warez", 1),
    ("https://warez-crack-serials.net/fr/43", 1),
    ("http://click-here-win-prize.com/en/9033", 1),
    ("https://free-prize-winner-claim.org/click", 1),
    ("http://popup-ads-clickbait.net/de/616", 1),
    ("https://www.university.edu/departments/history", 0),
    ("https://library.college.edu/catalogue/4821", 0),
    ("http://www.city-council.gov/services/parking", 0),
    ("https://weather.service.gov/forecast/today", 0),
    ("https://news.daily-herald.com/world/2019/07/elections", 0),
    ("http://www.morningpost.co.uk/sport/cricket/report", 0),
    ("https://en.encyclopedia.org/wiki/printing_press", 0),
    ("https://de.encyclopedia.org/wiki/buchdruck", 0),
    ("https://docs.software.org/guide/install.html", 0),
    ("https://developer.platform.com/en/reference/api", 0),
    ("https://blog.gardener.net/en/2018", 0),
    ("https://blog.traveller.com/fr/440", 0),
    ("http://blog.carpenter.org/en/61", 0),
    ("https://forum.photographers.net/thread/90211", 0),
    ("http://forum.linux-users.org/viewtopic?t=1234", 0),
    ("https://recipes.kitchen.com/en/733.html", 0),
    ("https://www.hospital.org/en/12", 0),
    ("https://www.museum.nl/en/8", 0),
    ("https://www.theatre.de/de/2020", 0),
    ("https://www.school.fr/fr/78", 0),
    ("https://shop.bookstore.es/es/312.html", 0),
    ("https://m.newspaper.es/es/5520", 0),
    ("https://m.railway.ch/de/95", 0),
    ("https://m.radio.com/en/88", 0),
    ("http://www.river-trust.org/en/707", 0),
    ("https://science.journal.org/articles/10.html", 0),
    ("https://papers.conference.org/2017/paper-41.pdf", 0),
    ("https://static.images.net/photos/1024.jpg", 0),
    ("https://open-data.statistics.eu/datasets/17", 0),
    ("https://maps.mountains.org/de/1180", 0),
    ("https://www.orchestra.com/en/3", 0),
    ("https://www.small-bakery.fr/fr/56", 0),
    ("https://www.village-hall.org/en/12.html", 0),
    ("https://jobs.company.com/en/334", 0),
    ("https://support.company.com/en/6071", 0),
    ("https://cdn.library.net/js/index.html", 0),
    ("https://stories.writers.net/en/29", 0),
    ("https://music.lessons.org/es/814", 0),
    ("https://astronomy.club.org/en/2021", 0),
    ("https://law.archive.gov/en/1954", 0),
    ("https://history.society.org/es/17", 0),
    ("https://podcasts.network.com/de/205", 0),
    ("https://www.another-house.net/en/4", 0),
    ("https://the-weather-station.org/fr/907", 0),
)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z as a-z; empty for null or without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Longest rule that fits, as text, and its verdict; null where none does.

    A rule fits its host and all subdomains, where the path starts with the rule's. Length is that of host and path
    together; of equally long ones that fit, the one with the longer host wins. ``rules`` is a short list that
    becomes one expression.
    """
    ordered = sorted(dict.fromkeys(rules), key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ordered]

    def pick(values):
        pairs = list(zip(fits, values))
        if not pairs:
            return F.lit(None).cast("string")
        return reduce(lambda whole, pair: whole.when(*pair), pairs[1:], F.when(*pairs[0]))

    return pick([F.lit(h + p) for h, p, _ in ordered]), pick([F.lit(v) for _, _, v in ordered])


def n_grams(text: Column, tag: str, sizes=GRAMS) -> Column:
    """Different runs of so many characters, with ``tag`` in front; shorter texts give nothing."""
    def runs(n):
        last = F.length(text) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(tag), F.substring(text, i, F.lit(n)))))

    found = [F.coalesce(runs(n), F.array().cast("array<string>")) for n in sizes]
    return F.array_distinct(F.concat(*found))


def with_grams(urls: DataFrame, url_col: str, name: str) -> DataFrame:
    """Adds the n-grams of host and path, the ends of each marked."""
    host = F.concat(F.lit("^"), host_of(col(url_col)), F.lit("$"))
    path = F.concat(F.lit("^"), path_of(col(url_col)), F.lit("$"))
    # Digits say nothing about a page: every one is 0.
    path = F.regexp_replace(path, "[0-9]", "0")
    return urls.withColumn(name, F.concat(n_grams(host, "h"), n_grams(path, "p")))


def fit_urls(spark: SparkSession, labelled=LABELLED, buckets: int = BUCKETS, strength: float = 0.01) -> LogisticRegressionModel:
    """Logistic regression on the hashed n-grams of a small labelled table of (url, 0 or 1)."""
    rows = with_grams(spark.createDataFrame([(u, float(y)) for u, y in labelled], "url string, label double").coalesce(1), "url", "grams")
    hashed = HashingTF(numFeatures=buckets, binary=True, inputCol="grams", outputCol="features").transform(rows)
    return LogisticRegression(regParam=strength, standardization=False, maxIter=100).fit(hashed)


def judge_urls(pages: DataFrame, model: LogisticRegressionModel, rules=RULES, url_col: str = "url", block: float = BLOCK) -> DataFrame:
    """``pages`` with host, path, rule, score (probability of block) and verdict added; taken names get underscores in front.

    The verdict is the rule's, else ``block`` from a probability of ``block`` on, else ``allow``. Null urls and those
    without ``://`` have empty host and path and are judged by the model like any other. Each row is judged by itself,
    so ties and repeats do not matter; all in one pass without a shuffle.
    """
    names = {n: fresh(pages, n) for n in ("host", "path", "rule", "score", "verdict")}
    work = [fresh(pages, n) for n in ("grams", "features", "rawPrediction", "probability", "prediction")]
    hashed = HashingTF(numFeatures=model.numFeatures, binary=True, inputCol=work[0], outputCol=work[1]).transform(
        with_grams(pages, url_col, work[0]))
    model = model.copy().setFeaturesCol(work[1]).setRawPredictionCol(work[2]).setProbabilityCol(work[3]).setPredictionCol(work[4])
    scored = model.transform(hashed).withColumn(names["score"], vector_to_array(col(work[3]))[1])
    scored = scored.withColumn(names["host"], host_of(col(url_col))).withColumn(names["path"], path_of(col(url_col)))
    rule, verdict = rule_for(col(names["host"]), col(names["path"]), rules)
    own = F.when(col(names["score"]) >= block, "block").otherwise("allow")
    return scored.withColumn(names["rule"], rule).withColumn(names["verdict"], F.coalesce(verdict, own)).drop(*work)
