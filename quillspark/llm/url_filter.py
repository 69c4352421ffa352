"""URL filters: rules by host and path, else logistic regression on hashed
character n-grams of host and path.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, with A-Z in
lower case; the path what follows up to `?`, `#` or the end. A rule fits its host and
all its subdomains where the path starts with the rule's; of those that fit the
longest decides. The model learns from a small table of labelled URLs, a parameter.

Edge cases: null urls and urls without `://` have an empty host and path, no rule and
the model's verdict; ties between rules of one length go to the first in order;
repeated rows are judged one by one; without labels of both kinds all is allowed."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: (url, 1 to block): a small table to learn from.
LABELLED = tuple(
    (u, 0)
    for u in (
        "https://en.encyclopedia.example/wiki/River 	https://docs.library.example/guide/install.html https://news.city.example/2021/05/council-meeting http://blog.garden.example/en/1201 "
        "https://www.university.example/department/history https://m.recipes.example/soup/leek https://museum.example/de/exhibits/204 http://forum.cycling.example/thread/5512?page=2 "
        "https://research.example/papers/1804.html https://www.school.example/en/timetable https://archive.example/fr/30211 https://help.editor.example/manual/shortcuts "
        "https://weather.example/es/forecast/madrid http://www.townhall.example/services/parking https://journal.example/issue/12/article-3 https://blog.kitchen.example/en/778/ "
        "https://science.example/de/9912.html https://opensource.example/project/readme https://maps.example/fr/region/alps https://m.stories.example/es/2511 "
        "http://river.example.net/en/30412 https://blog.harbor.example.com/de/8123#top http://m.meadow.example.org/fr/2277.html https://www.lantern.example.net/es/19023?page=2 "
        "https://law.example/statutes/section-4 https://health.example/en/conditions/asthma https://www.choir.example/concerts https://static.handbook.example/en/44501"
    ).split()
) + tuple(
    (u, 1)
    for u in (
        "http://free-casino-bonus.example/win/jackpot http://best-poker-slots.example/play-now https://cheap-pills-online.example/viagra/buy http://xxx-adult-cams.example/live/sex "
        "https://win-free-phone.example/claim/prize?id=1 http://ads.tracker.example/banner/click http://hot-singles.example/dating/xxx https://casino.example/slots/free-spins "
        "http://secure-login-verify.example/account/password http://crypto-double.example/invest/bonus http://torrent-crack.example/download/keygen.exe https://porn-tube.example/video/xxx "
        "http://cheap-replica-watches.example/buy/discount http://click.adserver.example/redirect/offer http://payday-loan-fast.example/apply-now https://sex-shop-cams.example/free "
        "http://warez.example/serial/crack/download http://bet-win-slots.example/jackpot/bonus https://pills-pharmacy.example/cheap/order http://lottery-prize.example/claim/winner "
        "http://spam-links.example.com/en/4012 https://ads-network.example.net/de/2291 http://track-pixel.example.org/fr/318.html http://m.casino-slots.example.com/es/991 "
        "https://adult-videos.example.net/en/7710?page=2 http://www.cheap-meds.example.org/de/66 https://free-betting.example.com/fr/5120 http://link-farm.example.net/en/874#top "
        "http://popup-ads.example/click/win https://adult.example/xxx/free http://seo-links.example/buy/backlinks http://miracle-diet.example/buy-now/discount"
    ).split()
)
BUCKETS = 1 << 14
SIZES = (3, 4, 5)


def parts(url: str = "url") -> tuple[Column, Column]:
    """(host, path) as columns."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram of bytes, host and path between marks."""
    raw = [b"^" + t.encode() + b"$" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    doc = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    docs, buckets = [], []
    for n in SIZES:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        same = doc[: len(h)] == doc[n - 1 :]
        docs.append(doc[: len(h)][same])
        buckets.append((h[same] % np.uint64(BUCKETS)).astype(np.int64))
    return (np.concatenate(docs), np.concatenate(buckets)) if docs else (np.zeros(0, np.int64),) * 2


def _split(url: str) -> str:
    """Host and path as ``parts`` gives them, with a blank between."""
    rest = url.partition("://")[2]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host) + " " + path


class Regression:
    """Logistic regression, L2; the value of an n-gram is 1 / sqrt(n-grams)."""

    def __init__(self, labelled=LABELLED, steps: int = 400, rate: float = 2.0, decay: float = 1e-3):
        y = np.array([v for _, v in labelled], float)
        self.weights, self.bias = np.zeros(BUCKETS), -1.0
        if len(set(y.tolist())) < 2:
            self.bias = -10.0
            return
        doc, bucket = _grams([_split(u) for u, _ in labelled])
        value = 1 / np.sqrt(np.bincount(doc, minlength=len(y)))[doc]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(np.bincount(doc, value * self.weights[bucket], len(y)) + self.bias)))
            g = (p - y) / len(y)
            self.weights -= rate * (np.bincount(bucket, value * g[doc], BUCKETS) + decay * self.weights)
            self.bias -= rate * g.sum()

    def score(self, texts: list[str]) -> np.ndarray:
        doc, bucket = _grams(texts)
        size = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
        return 1 / (1 + np.exp(-(np.bincount(doc, self.weights[bucket], len(texts)) / np.sqrt(size) + self.bias)))


def judge(pages: DataFrame, rules=RULES, labelled=LABELLED) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of pages (page_id, url)."""
    sent = pages.sparkSession.sparkContext.broadcast(Regression(labelled))

    @F.pandas_udf("double")
    def model(text):
        import pandas as pd

        return pd.Series(sent.value.score(text.tolist()))

    host, path = parts()
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    df = df.withColumn("score", model(F.concat_ws(" ", "host", "path")))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    return df.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"))
