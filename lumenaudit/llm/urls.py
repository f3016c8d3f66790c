"""URL filters: explicit rules first, then a logistic regression on hashed character n-grams.

The regression learns from a small labelled table of URLs; host and path have n-grams of their own.
Weights are a fixed-size vector, so what is broadcast does not depend on the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, SIZES = 14, (3, 4, 5)
#: (verdict, host, path): the longest that fits a url decides.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The small labelled table, written for this filter: names and paths to block and to allow. Each is
#: taken with every one of the prefixes and a domain ending, so that neither tells them apart.
BLOCKED = """casino-royal/play lucky-casino/slots?ref=1 win-big/en/1 free-bets/odds best-bets/live jackpot-slots/spin
cheap-pills/order pills-online/buy.html pharma-cheap/sale adult-cams/live xxx-adult/video.html adult-dating/de/7
ads-server/click?id=1 ad-track/pixel track-ads/r?u=2 banner-ads/view spam-mail/list
link-farm/page/2 content-farm/a.html spam-farm/en/3 free-money/win cash-win/now"""
ALLOWED = """city-library/en/catalogue garden/2020/roses weather/today daily-news/world/12.html software-docs/guide/install
roman-history/en/rome village-school/fr/cours/3 art-museum/de/ausstellung university/en/research/45 theatre/es/obras
kitchen/recipes/7.html cycling-forum/thread?page=2 science-journal/en/101#top radio/fr/emissions trains/de/plan
bookshop/en/item/88 town-council/news travel/es/ruta/9 hospital/en/visit?utm_source=feed number-theory/notes/12"""
PREFIXES, ENDINGS = ("", "www.", "m.", "blog."), (".com", ".net", ".org")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits (ties: the first by name), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def split_url(url: str) -> tuple[str, str]:
    """The same cut for the labelled table; a scheme may be missing there."""
    found = re.match(r"(?:.*?://)?([^/?#]*)([^?#]*)", url, re.S)
    return found[1].lower(), found[2]


def hashed(host: str, path: str) -> np.ndarray:
    """Buckets of the distinct n-grams of host and path, each part marked."""
    grams = {f"{part}{text[i : i + n]}" for part, text in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in SIZES for i in range(max(1, len(text) - n + 1))}
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(g) for g in grams), np.uint32, len(grams)) >> (32 - BITS))


def labelled_table() -> list[tuple[str, int]]:
    """(url, 1 to block)."""
    out = []
    for y, text in ((1, BLOCKED), (0, ALLOWED)):
        for i, entry in enumerate(text.split()):
            name, path = entry.split("/", 1)
            out += [(f"http://{prefix}{name}{ENDINGS[(i + k) % len(ENDINGS)]}/{path}", y) for k, prefix in enumerate(PREFIXES)]
    return out


def train(labelled: Iterable[tuple[str, int]] | None = None, rounds: int = 500, rate: float = 0.05, ridge: float = 0.002) -> np.ndarray:
    """Weights, the last one the bias. labelled: (url, 1 to block); a few thousand at most."""
    rows = [(hashed(*split_url(u)), y) for u, y in (labelled_table() if labelled is None else labelled)]
    weights = np.zeros((1 << BITS) + 1)
    used = np.unique(np.concatenate([at for at, _ in rows])) if rows else np.zeros(0, np.int64)
    x = np.zeros((len(rows), len(used) + 1))
    for i, (at, _) in enumerate(rows):
        x[i, np.searchsorted(used, at)] = 1
    x[:, -1] = 1
    y, w = np.array([y for _, y in rows], float), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w -= rate * (x.T @ (p - y) / max(1, len(rows)) + ridge * w)
    weights[used], weights[-1] = w[:-1], w[-1]
    return weights


def score(weights: np.ndarray, host: str, path: str) -> float:
    return float(1 / (1 + np.exp(-(weights[hashed(host, path)].sum() + weights[-1]))))


def filter_urls(pages: DataFrame, weights: np.ndarray | None = None, rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.6, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of ``pages``.

    A url that is null or has no ``://`` has an empty host and path. score: the regression's, for
    rows that a rule decided as well; without a rule a url is blocked from ``threshold`` on, which lies
    above the score of a name of which nothing is known. Other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train() if weights is None else weights)

    @F.arrow_udf("double")
    def judge(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hosts, paths in parts:
            yield pa.array([score(shared.value, h.as_py(), p.as_py()) for h, p in zip(hosts, paths)], pa.float64())

    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("score", judge("host", "path")).withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", own).alias("verdict"), "score")
