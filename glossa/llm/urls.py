"""URL filters: host and path rules, then logistic regression on hashed n-grams.

Features are character n-grams of host and path, hashed into a fixed number of
buckets, and a few numbers of what the url looks like; the weights are fitted on the small
labelled table below when the query is planned and enter the plan as one constant array, so
scoring is a projection.  N-grams are cut from parts of PART characters, so time grows with the
url's length alone.  The table's names come from public lists by a rule that was set before any url of a given
table was scored, and its threshold from the table alone.

Defined results: a null url, or one without '://', has empty host and path, no rule
and the model's verdict on empty strings, which is 'allow' (tested);
a url of any length is judged whole; repeated rows are judged alike; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (verdict, host, path): the rules of the contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: The labelled table is made by `labelled_urls` from these names; label 1: block.
#: Good names: the 200 pictured things of the Basic English word list, all of them.
GOOD_NAMES = """
angle ant apple arch arm army baby bag ball band basin basket bath bed bee bell berry bird blade board boat bone book boot bottle box boy brain brake branch brick bridge brush bucket bulb button cake
camera card carriage cart cat chain cheese chest chin church circle clock cloud coat collar comb cord cow cup curtain cushion dog door drain drawer dress drop ear egg engine eye face farm feather finger
fish flag floor fly foot fork fowl frame garden girl glove goat gun hair hammer hand hat head heart hook horn horse hospital house island jewel kettle key knee knife knot leaf leg library line lip lock map
match monkey moon mouth muscle nail neck needle nerve net nose nut office orange oven parcel pen pencil picture pig pin pipe plane plate plough pocket pot potato prison pump rail rat receipt ring rod roof
root sail school scissors screw seed sheep shelf ship shirt shoe skin skirt snake sock spade sponge spoon spring square stamp star station stem stick stocking stomach store street sun table tail thread throat
thumb ticket toe tongue tooth town train tray tree trousers umbrella wall watch wheel whip whistle window wing wire worm
""".split()
#: Bad names: words of the categories that public blocklists keep (gambling, medicines, adult, loans, piracy, malware, link trade).
BAD_NAMES = """
poker roulette blackjack jackpot slots lottery bingo bookmaker wager gambling baccarat viagra cialis steroid opioid tramadol pharmacy porn escort webcam nude fetish hookup milf
payday forex loan replica counterfeit warez torrent keygen crack malware phishing botnet ransomware popunder clickbait backlink doorway
""".split()
#: What bad names are joined with.
BAD_WITH = "best buy online deal bonus offer vip now discount club cash hot top quick big lucky instant super".split()
SUBDOMAINS, DOMAINS, PATHS = ("", "www.", "blog.", "m."), ("com", "net", "org", "example", "example.com", "example.net"), ("en", "de", "fr", "es", "item", "p")
BUCKETS, SIZES, EPOCHS, RATE, DECAY = 16384, (3, 4, 5), 600, 8.0, 1e-4
PART = 32
#: Buckets after those of n-grams, for what a url looks like: hyphens, digits, labels and length of the host, depth and digits of the path.
STYLES = 8
#: The least score that is blocked: the one that tells most urls of `labelled_urls` right when each fifth of the names is left out in turn (tested).
THRESHOLD = 0.5


def labelled_urls() -> list[tuple[int, str, str]]:
    """(label, name, url): every name in hosts of its own.

    A good name stands alone, before and after the next name, and in one case of four with a hyphen between.
    A bad name stands alone, and with companions: in two cases of three with a hyphen, else joined or with digits.
    What stands around the hosts (scheme, subdomain, domain, path) goes round alike for both labels.
    """
    out = []
    for label, names in ((1, BAD_NAMES), (0, GOOD_NAMES)):
        for i, name in enumerate(names):
            if label:
                a, b, c = (BAD_WITH[(3 * i + k) % len(BAD_WITH)] for k in range(3))
                hosts = [name, f"{name}-{a}", f"{b}-{name}", f"{c}{name}", f"{name}-{c}", f"{a}-{name}", f"{name}{b}", f"{name}{i}", f"{b}-{name}-{a}", f"{c}-{name}{i}", f"{name}-{b}", f"{c}-{name}"]
            else:
                a, b, c = (names[(i + k) % len(names)] for k in (41, 97, 139))
                hosts = [name, f"{name}{a}", f"{b}{name}", f"{name}{i}" if i % 5 == 0 else f"{a}{name}", f"{name}-{c}" if i % 2 == 0 else f"{c}{name}"]
            for k, host in enumerate(hosts):
                at = 7 * i + 5 * k
                tail = ("", ".html", "/", "?page=2")[at % 4]
                out.append((label, name, f"http{'s' * (at % 2)}://{SUBDOMAINS[at // 2 % 4]}{host}.{DOMAINS[at % 6]}/{PATHS[at // 6 % 6]}/{131 * at % 997}{tail}"))
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path; both empty where there is no '://'."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as host and path together, and its verdict; null if none fits.

    The rules become one CASE, longest first; meant for short lists such as a site policy.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _grams(kind: str, part: Column) -> Column:
    """Buckets of the n-grams that begin among the first PART characters."""

    def of_size(n: int) -> Column:
        count = F.least(F.lit(PART), F.length(part) - (n - 1))
        one = lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substring(part, i, F.lit(n))), F.lit(BUCKETS)).cast("int")
        return F.when(count >= 1, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), one)).otherwise(F.array().cast("array<int>"))

    return F.concat(*(of_size(n) for n in SIZES))


def grams(host: Column, path: Column) -> Column:
    """Bucket numbers of all n-grams of '^host$' and of the path without digits, one entry for each occurrence."""
    parts = lambda text: F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{PART + max(SIZES) - 1}}})).{{1,{PART}}}"), F.lit(1))
    of_host = F.transform(parts(F.concat(F.lit("^"), host, F.lit("$"))), lambda x: _grams("h", x))
    of_path = F.transform(parts(F.regexp_replace(path, "[0-9]+", "0")), lambda x: _grams("p", x))
    return F.flatten(F.concat(of_host, of_path))


def styles(host: Column, path: Column) -> Column:
    """array<double>: STYLES numbers from 0 to 1."""
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    share = lambda text, pattern: count(text, pattern) / F.greatest(F.length(text), F.lit(1))
    upto = lambda c, most: F.least(c / most, F.lit(1.0))
    hyphens, inner = count(host, "-"), host.contains("xn--")
    return F.array(
        (hyphens > 0).cast("double"), upto(hyphens, 4.0), share(host, "[0-9]"), upto(count(host, r"\."), 5.0), upto(F.length(host).cast("double"), 40.0),
        upto(count(path, "/[^/]"), 6.0), share(path, "[0-9]"), inner.cast("double"),
    )


def _fit(rows: list[tuple[int, list[int], list[float]]]) -> tuple[list[float], float]:
    """Batch gradient descent over the labelled table, some thousand rows, on the driver."""
    y = np.array([label for label, _, _ in rows], float)
    even = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both labels weigh as much
    sizes = np.array([len(b) for _, b, _ in rows])
    at, first = np.concatenate([b for _, b, _ in rows]), np.cumsum(sizes) - sizes
    x, s = np.repeat(1 / np.sqrt(sizes), sizes), np.array([v for _, _, v in rows])
    w, v, bias = np.zeros(BUCKETS), np.zeros(STYLES), 0.0
    for _ in range(EPOCHS):
        off = (y - 1 / (1 + np.exp(-bias - s @ v - np.add.reduceat(w[at] * x, first)))) * even
        w += RATE * (np.bincount(at, np.repeat(off, sizes) * x, BUCKETS) - DECAY * w)
        v += RATE * (off @ s - DECAY * v)
        bias += RATE * float(off.sum())
    return [round(float(c), 6) for c in (*w, *v)], round(bias, 6)


def labelled_features(spark: SparkSession) -> list[tuple[int, list[int], list[float], str]]:
    """Label, n-gram buckets, styles and name of every labelled url, in order of the table."""
    df = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, {y}, '{n}', '{u}')" for i, (y, n, u) in enumerate(labelled_urls())) + " AS t(i, y, name, url)")
    host, path = split_url(F.col("url"))
    df = df.select("i", "y", "name", host.alias("h"), path.alias("p"))
    got = df.select("i", "y", grams(F.col("h"), F.col("p")).alias("x"), styles(F.col("h"), F.col("p")).alias("s"), "name").collect()
    return [(r["y"], r["x"], r["s"], r["name"]) for r in sorted(got, key=lambda r: r["i"])]


@lru_cache(maxsize=1)
def model(spark: SparkSession) -> tuple[list[float], float]:
    return _fit([r[:3] for r in labelled_features(spark)])


def score(x: Column, s: Column, weights: list[float], bias: float) -> Column:
    """Chance that the url is to be blocked."""
    w = F.split(F.lit(",".join(map(repr, weights[:BUCKETS]))), ",").cast("array<double>")
    total = F.aggregate(x, F.lit(0.0), lambda acc, b: acc + F.element_at(w, b + 1))
    look = sum((F.get(s, F.lit(i)) * float(v) for i, v in enumerate(weights[BUCKETS:])), F.lit(0.0))
    return 1 / (1 + F.exp(-(F.lit(bias) + look + total / F.sqrt(F.greatest(F.size(x), F.lit(1))))))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of `pages`."""
    weights, bias = model(pages.sparkSession)
    host, path = split_url(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    x, s = grams(F.col("host"), F.col("path")), styles(F.col("host"), F.col("path"))
    out = out.select("*", rule.alias("rule"), verdict.alias("ruled"), score(x, s, weights, bias).alias("score"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
