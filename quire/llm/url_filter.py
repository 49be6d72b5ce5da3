"""URL filters: host and path rules, and logistic regression for urls without a rule.

The features are hashed character n-grams of host and path.  The model is fitted on the driver
from a small labelled url table, as one full-batch descent over a fixed number of weights; the
judging of urls is DataFrame expressions only and moves no rows.  Weights are rounded to
integers, so a sum does not depend on its order.

A url without ``://`` and a null url have an empty host and an empty path, which no rule fits
and which the model judges as any other.  Ids may repeat or be null.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Weights are stored as multiples of 1 / UNIT.
UNIT = 1 << 20
SIZES = (3, 4)

# A small labelled table: urls to block, then urls to allow.
BLOCKED = """
http://www.casino-royal.example.com/en/100
https://best-casino.example.org/fr/bonus
http://m.online-casino.example.net/de/7.html
https://win-big.example.com/es/12345
http://blog.winner-club.example.org/en/33
http://jackpot-win.example.net/en/play
https://slots-free.example.com/de/900
http://poker-bets.example.org/es/41
https://sports-bets.example.com/en/22187
http://m.bets-now.example.org/fr/5
http://cheap-loans.example.com/en/200
https://cheap-watches.example.org/de/31
http://blog.cheap-meds.example.com/fr/801.html
https://diet-pills.example.net/en/48
http://pills-shop.example.org/es/77
https://m.buy-pills.example.com/de/6001
http://viagra-store.example.org/en/3
https://free-money.example.com/en/17
http://free-gift.example.org/fr/10021
https://www.free-download.example.com/es/99
http://adult-chat.example.org/en/18
https://m.adult-video.example.com/de/69
http://adult-dating.example.net/fr/2400
https://xxx-tube.example.com/en/1
http://sex-cam.example.org/es/300
https://porn-x.example.com/en/55
http://spam-mail.example.net/en/70
https://link-farm.example.org/de/811
http://blog.seo-farm.example.com/fr/19
https://content-spam.example.com/es/6
http://www.ads-server.example.org/en/click
https://ads-network.example.com/en/4055
http://click-track.example.net/de/88
https://m.track-pixel.example.org/fr/7001
http://popup-ads.example.com/es/29
https://tracker.example.org/en/ads/1
http://malware-site.example.com/en/exe
https://phish-login.example.org/de/44
http://crypto-double.example.com/en/9
https://get-rich.example.net/fr/500
http://warez-crack.example.org/es/80
https://torrent-hub.example.com/en/640
"""
ALLOWED = """
http://www.example.com/en/100
https://example.org/fr/about
http://m.example.net/de/7.html
https://library.example.com/es/12345
http://blog.gardening.example.org/en/33
http://museum.example.net/en/history
https://news.example.com/de/900
http://university.example.org/es/41
https://science.example.com/en/22187
http://m.weather.example.org/fr/5
http://school.example.com/en/200
https://recipes.example.org/de/31
http://blog.travel.example.com/fr/801.html
https://music.example.net/en/48
http://books.example.org/es/77
https://m.maps.example.com/de/6001
http://hospital.example.org/en/3
https://city-council.example.com/en/17
http://open-data.example.org/fr/10021
https://www.health-guide.example.com/es/99
http://thomas.example.org/en/18
https://m.theatre.example.com/de/69
http://nation.example.net/fr/2400
https://station.example.com/en/1
http://weather-report.example.org/es/300
https://history.example.com/en/55
http://translation.example.net/en/70
https://theory.example.org/de/811
http://blog.thread.example.com/fr/19
https://thousand.example.com/es/6
http://www.standing.example.org/en/page
https://anderson.example.com/en/4055
http://interest.example.net/de/88
https://m.heathland.example.org/fr/7001
http://errand.example.com/es/29
https://other.example.org/en/index/1
http://nothing.example.com/en/text
https://question.example.org/de/44
http://marble.example.com/en/9
https://bletchley.example.net/fr/500
http://tionesta.example.org/es/80
https://enough.example.com/en/640
http://thirteen.example.net/en/43607?utm_source=feed
https://blog.southern.example.org/de/24180/
http://m.rentals.example.com/es/1778#top
https://www.washington.example.net/en/17213.html
"""


def seed_table() -> list[tuple[str, int]]:
    """(url, label) with label 1 for block."""
    return [(u, 1) for u in BLOCKED.split()] + [(u, 0) for u in ALLOWED.split()]


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of one url, as :func:`host` and :func:`path` give them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    end = min(ends) if ends else len(rest)
    tail = rest[end:]
    stops = [tail.find(c) for c in "?#" if c in tail]
    return rest[:end].translate(str.maketrans(UPPER, LOWER)), tail[: min(stops) if stops else len(tail)]


def n_grams(host: str, path: str) -> list[str]:
    text = f"<{host}>{path}"
    return [text[i : i + n] for n in SIZES for i in range(max(len(text) - n + 1, 1))]


def bucket(gram: str, buckets: int) -> int:
    return int(hashlib.md5(gram.encode(), usedforsecurity=False).hexdigest()[:6], 16) % buckets


@dataclass(frozen=True)
class UrlModel:
    """Integer weights of the buckets and a bias; a positive sum means block."""

    weights: tuple[int, ...]
    bias: int


def fit_urls(
    labelled: list[tuple[str, int]], buckets: int = 2048, steps: int = 400, rate: float = 0.5, decay: float = 1e-3
) -> UrlModel:
    """Logistic regression by gradient descent over a small table of (url, label)."""
    x = np.zeros((len(labelled), buckets))
    for row, (url, _) in zip(x, labelled, strict=True):
        for gram in n_grams(*split_url(url)):
            row[bucket(gram, buckets)] += 1
    y = np.array([label for _, label in labelled], dtype=np.float64)
    w, b = np.zeros(buckets), 0.0
    for _ in range(steps if len(y) else 0):
        error = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        w -= rate * (x.T @ error / len(y) + decay * w)
        b -= rate * error.mean()
    return UrlModel(tuple(int(v) for v in np.round(w * UNIT)), int(round(b * UNIT)))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of a short list of (verdict, rule) that fits, as a struct, or null.

    A rule is a host and the beginning of a path; it fits the host and all its subdomains.
    """
    result = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        result = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(text).alias("rule"))).otherwise(result)
    return result


def margin(host: Column, path: Column, model: UrlModel) -> Column:
    """The integer sum of the weights of all n-grams, repeats counted, and the bias."""
    weights = F.expr(f"array({', '.join(f'{w}L' for w in model.weights)})")

    def add_gram(chars: Column, n: int):
        # Characters are taken from the list: a substring would count from the start each time.
        def add(sum_: Column, i: Column) -> Column:
            gram = F.concat_ws("", *[F.get(chars, i + (k - 1)) for k in range(n)])
            key = F.conv(F.substring(F.md5(F.encode(gram, "utf-8")), 1, 6), 16, 10).cast("int")
            return sum_ + F.element_at(weights, key % len(model.weights) + 1)

        return add

    def total(chars: Column) -> Column:
        value = F.lit(model.bias).cast("bigint")
        for n in SIZES:
            starts = F.sequence(F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(1)))
            value = F.aggregate(starts, value, add_gram(chars, n))
        return value

    # The list is bound to a lambda variable, so that it is made once for each url.
    text = F.concat(F.lit("<"), host, F.lit(">"), path)
    return F.get(F.transform(F.array(F.split(text, "")), total), F.lit(0))


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Per page ``host``, ``path``, the ``rule`` that decides (else null) and the ``verdict``."""
    parts = pages.select(F.col(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    ruled = parts.withColumn("_rule", rule(F.col("host"), F.col("path"), rules))
    learned = F.when(margin(F.col("host"), F.col("path"), model) > 0, "block").otherwise("allow")
    return ruled.select(
        id_col, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), learned).alias("verdict")
    )


def sql(rules: list[tuple[str, str]], model: UrlModel) -> str:
    """The same result over the table ``pages`` for a database with Python-like list functions."""
    cases = []
    for verdict, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, slash, rest = text.partition("/")
        cases.append(
            f"when (host = '{own}' or ends_with(host, '.{own}')) and starts_with(path, '{slash + rest}') "
            f"then {{'verdict': '{verdict}', 'rule': '{text}'}}"
        )
    grams = " union all ".join(
        f"select no, unnest(list_transform(range(1, greatest(length(t) - {n - 1}, 1) + 1), "
        f"lambda i: substr(t, i, {n}))) as gram from judged"
        for n in SIZES
    )
    return f"""
with weights as (
  select unnest(range(0, {len(model.weights)})) as bucket, unnest({list(model.weights)}) as weight
), rest as materialized (
  select page_id, row_number() over () as no,
         case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as r
  from pages
), parts as (
  select page_id, no, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
         regexp_extract(r, '^[^/?#]*(/[^?#]*)?', 1) as path
  from rest
), judged as (
  select *, case {' '.join(cases)} end as j, '<' || host || '>' || path as t from parts
), grams as (
  {grams}
), sums as (
  select no, sum(weight) as total
  from grams join weights
    on bucket = cast('0x' || substr(md5(gram), 1, 6) as bigint) % {len(model.weights)}
  group by no
)
select page_id, host, path, j.rule as rule,
       coalesce(j.verdict, case when {model.bias} + total > 0 then 'block' else 'allow' end) as verdict
from judged join sums using (no)
"""
