"""Operator 2, URL filters: host and path rules, and a logistic regression on hashed character n-grams for all other URLs.

The model learns from a small labelled table of URLs, given below; its weights are a fixed number of buckets, so what is
broadcast does not grow with the data. Rules come first: the longest that fits decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BITS, GRAMS = 16, (3, 4, 5)

# The rules of the query, as (verdict, rule).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

# Labelled URLs to learn from, without their ``http://``. The first are to be blocked.
BLOCK = """
spam-farm.example.org/en/12 www.spam-mail.example.com/win/free cheap-pills.example.com/en/3 www.pills-online.example.org/buy/now
free-casino.example.com/bonus casino-bonus.example.org/slots adult-cams.example.com/live xxx-videos.example.org/hot win-prize.example.com/claim
cheap-replica.example.com/watches payday-loans.example.org/apply quick-loans.example.com/cash m.pillstore.example.com/de/44 viagra-shop.example.org/cheap
betting-tips.example.com/odds poker-farm.example.org/play spam.example.com/en/7 link-farm.example.com/seo/backlinks
free-download-crack.example.org/keygen torrent-crack.example.com/warez clickbait-farm.example.com/you-wont-believe crypto-doubler.example.org/invest
malware-drop.example.com/setup.exe phish-login.example.org/verify-account blog.sexcams.example.com/en/9 www.porn-tube.example.org/es/21
hotxxx.example.com/fr/8 bets24.example.org/en/100 m.bestbets.example.com/es/3 freebet.example.org/en/55 www.casino777.example.com/de/1
ad-tracker.example.com/en/2 tracking-ads.example.org/pixel popup-ads.example.com/en/90 adserver.example.org/click m.adclick.example.com/fr/6
lottery-winner.example.com/en/31 winbig.example.org/jackpot jackpot-slots.example.com/en/5 slotsonline.example.org/spin
keygen-warez.example.com/en/9 cracked-software.example.org/serial free-torrents.example.com/en/41 nude-girls.example.com/pics
escort-dating.example.org/en/13 hookup-sex.example.com/de/8 spamblog.example.com/en/2 adultfriend.example.org/fr/30 pharma-spam.example.com/es/9
backlink-seo.example.org/en/71 phishing-bank.example.com/login.php malware-host.example.org/en/19 virus-scan-alert.example.com/alert
porn-hd.example.org/en/4 amateurporn.example.com/de/2 xxx.example.com/en/1 teenxxx.example.org/es/6 sex-shop.example.com/en/18 livesex.example.org/fr/5
lotto-lottery.example.com/en/3 lotteryticket.example.org/en/60 win-iphone.example.com/en/12 prize-winner.example.org/de/7 bigprizes.example.com/en/8
slot-machine.example.org/en/2 bet365win.example.com/en/4 sportsbet.example.org/es/2 betnow.example.com/fr/1 onlinepoker.example.com/en/39
viagra.example.com/en/5 buy-cialis-viagra.example.org/en/9 payday.example.com/en/71 cashadvance.example.org/en/22 loans.example.com/en/16
crackz-warez.example.org/en/3 warez.example.com/en/14 keygen.example.org/en/8 serial-crack.example.com/en/25 torrents.example.org/en/33
adtrack.example.com/en/47 ads-network.example.org/en/2 trackclick.example.com/en/62 phish.example.com/en/38 phishkit.example.org/de/4
seolinks.example.com/en/19 linkfarm.example.org/en/44 nudes.example.com/en/21 nude-cam.example.org/es/3 instant-loan.example.com/en/54
""".split()
ALLOW = """
news.example.org/en/2021/politics www.theatre.example.com/en/450 blog.gardener.example.org/es/12 m.weather.example.com/en/25
library.example.org/fr/catalogue/88 docs.example.com/guide/install.html www.university.example.org/en/research blog.travel.example.com/de/berlin
history.example.org/en/731 museum.example.com/en/visit www.thread.example.org/en/148.html thermal.example.com/en/676 blog.theory.example.org/es/575
m.ion.example.com/fr/825 recipes.example.org/en/soup health.example.org/en/advice science.example.com/en/articles/69 code.example.org/repo/readme
forum.example.com/en/thread/20 www.court.example.org/en/cases/334 the.example.com/en/217 sport.example.org/en/scores music.example.com/en/album/9
www.then.example.org/en/680 nation.example.com/en/9 www.station.example.org/de/18 m.education.example.com/es/77 therapist.example.org/en/3
northern-rail.example.com/en/61 www.harrington.example.org/en/84 blog.thames.example.com/en/7 m.thornton.example.org/fr/19 ether.example.com/en/2
www.mother-and-baby.example.org/en/58 southport.example.com/en/40 brother.example.org/de/33 www.leather.example.com/en/15 heritage.example.org/es/91
www.weaver.example.com/en/120 hand-made.example.org/en/14 m.rothbard.example.com/en/205 tennis-club.example.org/en/6 www.adventure.example.com/fr/44
sparrow.example.org/en/65 blog.adams.example.com/en/88 m.academy.example.org/fr/3 www.casa-nova.example.com/es/10 sextant.example.org/en/5
essex-county.example.com/en/28 www.poke-bowl.example.org/en/31 farm-shop.example.com/en/2 www.farming.example.org/de/61 link.example.com/en/74
www.download-fonts.example.com/en/81 tracks.example.org/en/6 www.track-and-field.example.com/en/23 adsorption.example.org/en/111 pillar.example.com/es/64
blog.quickstep.example.org/en/9 thistle.example.com/en/52 m.tenth.example.org/de/5 www.anthem.example.com/en/310 retention.example.org/en/48
www.notions.example.com/fr/26 m.tionesta.example.org/en/73 shared-table.example.com/en/4 www.thrush.example.org/en/16 able.example.com/en/90
table-tennis.example.org/es/35 www.wharton.example.com/en/8 m.thirteen.example.org/en/66 others.example.com/de/41 www.indeed.example.org/en/29
cyclists.example.com/en/71 book-club.example.org/en/8 www.pottery-class.example.com/en/5 parish-news.example.org/de/2 orchestral.example.com/en/92
winery.example.org/fr/60 www.novels.example.com/en/34 blog.workshop.example.org/en/17 bishop.example.com/en/43 m.notebooks.example.org/es/7
encyclopedia.example.com/en/55 www.spinning-wool.example.org/en/3 potatoes.example.com/en/24 online-maps.example.org/en/80 marine.example.com/fr/11
www.artist.example.org/en/46 listings.example.com/de/9 village-green.example.org/en/30 plots-and-gardens.example.com/en/21 m.trackside.example.org/en/58
linen.example.com/en/14 www.internet-museum.example.org/en/2 alpine.example.com/de/63 blog.freshwater.example.org/en/37 sussex.example.com/en/10
www.scam-advice-bureau.example.org/en/4 camera-club.example.com/en/29 campus.example.org/es/41 cashew-farm.example.com/en/8 www.seasons.example.org/en/50
theology.example.com/en/12 blog.ghana.example.org/en/53 m.athens.example.com/fr/18 www.thousand.example.org/en/9 twenty-two.example.com/en/70
""".split()
LABELLED = [(f"http://{url}", 1) for url in BLOCK] + [(f"https://{url}", 0) for url in ALLOW]
# What says nothing about a URL; every labelled one is learned with these, too.
PREFIXES, SUFFIXES, PATHS = ("", "www.", "m.", "blog."), ("com", "org", "net"), ("/en/217", "/de/5", "/fr/88.html", "/es/9/")


def host_and_path(url):
    """Host (after the first ``://``, A-Z lower-cased) and path columns; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.coalesce(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the character n-grams of hosts and paths, each once in a row; the two parts hash apart. Long URLs are read whole."""
    found = []
    for salt, texts in enumerate((hosts, paths), 1):
        raw = [f"^{t}$".encode("utf-8", "replace") for t in texts]
        row = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        for n in GRAMS:
            h = np.full(max(0, len(flat) - n + 1), 31 * salt + n, np.uint64)
            for k in range(n):
                h = (h ^ flat[k : k + len(h)]) * np.uint64(0x100000001B3)
            h = (h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
            inside = row[: len(h)] == row[n - 1 :]  # no n-gram spans two URLs
            found.append((row[: len(h)] << BITS) + h.astype(np.int64) if inside.all() else ((row[: len(h)] << BITS) + h.astype(np.int64))[inside])
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & (1 << BITS) - 1


def scores(weights: np.ndarray, bias: float, hosts: list[str], paths: list[str]) -> np.ndarray:
    """The probability, by the model, that each URL is to be blocked."""
    row, bucket = features(hosts, paths)
    n = np.bincount(row, minlength=len(hosts))
    return 1 / (1 + np.exp(-(np.bincount(row, weights[bucket], len(hosts)) / np.sqrt(np.maximum(n, 1)) + bias)))


def varied(rows: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """The rows, and each host with other prefixes, suffixes and paths, in turn, so that the model learns to look past them."""
    out = list(rows)
    for i, (host, path, label) in enumerate(rows):
        name = host.removeprefix("www.").removeprefix("m.").removeprefix("blog.").rpartition(".")[0]
        for k, prefix in enumerate(PREFIXES):
            out.append((f"{prefix}{name}.{SUFFIXES[(i + k) % len(SUFFIXES)]}", PATHS[(i // 2 + k) % len(PATHS)], label))
    return out


def fit(rows: list[tuple[str, str, int]], epochs: int = 600, rate: float = 20.0, decay: float = 5e-6) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent on the mean log loss, both labels weighing alike; features have length 1.

    Weights are sums of the rows' features, so each step updates one number a row (the products of rows are taken once)."""
    row, bucket = features([h for h, *_ in rows], [p for _, p, _ in rows])
    used, column = np.unique(bucket, return_inverse=True)
    x, y = np.zeros((len(rows), len(used)), np.float32), np.array([label for *_, label in rows], np.float32)
    x[row, column] = 1
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    products, a, b, share = x @ x.T, np.zeros(len(rows), np.float32), 0.0, np.where(y > 0, y.mean(), 1 - y.mean())
    for _ in range(epochs):
        error = (1 / (1 + np.exp(-(products @ a + b))) - y) / (2 * share)
        a -= rate * (error / max(1, len(y)) + decay * a)
        b -= float(error.mean()) if len(y) else 0
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = x.T @ a
    return weights, b


def plain_host_path(url: str) -> tuple[str, str]:
    """The same split as :func:`host_and_path`, for the labelled table."""
    _, mark, rest = url.partition("://")
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    path = rest[cut:]
    end = min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))
    return (rest[:cut].lower(), path[:end]) if mark else ("", "")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: list[tuple[str, int]] = LABELLED, threshold: float = 0.45) -> DataFrame:
    """One row per row of ``pages(page_id, url)``: page_id, host, path, rule, verdict, score.

    A rule ``host/path`` fits its host and all subdomains when the URL's path starts with ``/path``; the longest wins, of equal
    lengths the first given. A null or broken URL has empty host and path, fits no rule, and is allowed, having nothing to
    judge by. Null ids stay; repeated rows are judged each; an empty table gives no rows; other columns are ignored.
    """
    weights, bias = fit(varied([(*plain_host_path(url), label) for url, label in labelled]))
    box = pages.sparkSession.sparkContext.broadcast((weights, bias))

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(np.where((host != "") | (path != ""), scores(*box.value, host.tolist(), path.tolist()), 0.0))

    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    best = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):  # later ones are longer and win
        name, _, start = rule.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith("/" + start)
        best = F.when(fits, F.lit(rule)).otherwise(best)
    given = F.coalesce(*(F.when(F.col("rule") == rule, F.lit(v)) for v, rule in rules), F.lit(None).cast("string")) if rules else F.lit(None).cast("string")
    judged = split.withColumn("rule", best).withColumn("score", score("host", "path"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce(given, F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"), "score")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every URL of ``pages``."""
    return filter_urls(table(spark, sf_dir, "pages"))
