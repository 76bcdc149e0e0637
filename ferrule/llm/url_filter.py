"""URL rules, and for the rest logistic regression on hashed character n-grams of host and path.

The model is trained from the small labelled table below, in full: its gradients are a few thousand additions, so it needs
no job. Its weights are rounded to integers and enter the plan as one literal array, so scores are exact everywhere.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict). A rule fits its host and all subdomains if the path starts with its path; the longest wins.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Hash buckets, characters in a gram, multipliers of their code points; weights are in units of 1/SCALE.
BUCKETS, GRAM, FACTORS, SCALE = 2048, 4, (1, 131, 17161, 2248091), 1000
HOST_SALT, PATH_SALT, SPREAD = 7, 1031, 10

#: The labelled URL table: host, path, and 1 for block. Within a host's kind paths differ, and some hosts have both labels, so
#: hosts and paths both carry signal.
LABELLED = (
    ("discount-pills.example.com", "/buy/viagra-online-cheap.html", 1),
    ("www.cheap-meds.example.org", "/order/no-prescription", 1),
    ("pharmacy-deals.example.net", "/en/cialis-discount", 1),
    ("link-farm.city.info", "/links/page99.html", 1),
    ("blog.spam-links.example.com", "/tag/free-backlinks", 1),
    ("seo-boost.example.org", "/buy-links-now", 1),
    ("adult-video.example.com", "/xxx/hot-girls/12", 1),
    ("m.adult-cams.example.net", "/live/sex-chat", 1),
    ("hot-xxx.example.org", "/free-porn/clips", 1),
    ("casino-bonus.example.com", "/slots/free-spins", 1),
    ("www.poker-online.example.net", "/casino/bonus-code", 1),
    ("bet-win.city.info", "/sports-betting/odds", 1),
    ("replica-watches.example.com", "/cheap/rolex-replica", 1),
    ("luxury-outlet.example.org", "/replica-handbags/sale", 1),
    ("payday-loans.example.net", "/apply/instant-cash", 1),
    ("fast-credit.example.com", "/no-credit-check-loan", 1),
    ("keygen-crack.example.org", "/download/serial-key.exe", 1),
    ("torrent-warez.example.net", "/crack/full-version", 1),
    ("win-prizes.example.com", "/claim/free-iphone", 1),
    ("lottery-winner.city.info", "/you-won/claim-prize", 1),
    ("work-from-home.example.org", "/make-money-fast", 1),
    ("miracle-diet.example.com", "/lose-weight-fast/pills", 1),
    ("forum.cooking.example.com", "/profile/buy-viagra-cheap", 1),
    ("www.university.example.org", "/~user9/casino-free-spins", 1),
    ("blog.garden.example.net", "/comments/replica-watches-sale", 1),
    ("docs.project.example.com", "/wiki/spam/payday-loan", 1),
    ("wiki.games.example.org", "/user/free-porn-links", 1),
    ("free-hosting.example.net", "/a8f3/cheap-pills.html", 1),
    ("news.example.com", "/en/world/2019/election", 0),
    ("www.library.example.org", "/catalogue/history/1848", 0),
    ("blog.garden.example.net", "/en/planting-roses", 0),
    ("museum.city.info", "/exhibitions/modern-art", 0),
    ("docs.project.example.com", "/reference/install.html", 0),
    ("books.example.org", "/fr/romans/page/7", 0),
    ("m.weather.example.com", "/forecast/berlin", 0),
    ("forum.cooking.example.com", "/thread/bread-recipe", 0),
    ("www.university.example.org", "/physics/lectures/week3", 0),
    ("maps.travel.example.net", "/route/lisbon-porto", 0),
    ("recipes.example.com", "/soup/tomato-basil", 0),
    ("www.history.example.org", "/medieval/castles", 0),
    ("school.example.net", "/timetable/autumn", 0),
    ("data.science.example.com", "/papers/regression.pdf", 0),
    ("m.stories.example.org", "/es/cuentos/12", 0),
    ("blog.travel.example.com", "/2021/06/mountain-walk", 0),
    ("theatre.city.info", "/programme/hamlet", 0),
    ("www.health.example.org", "/advice/sleep-and-exercise", 0),
    ("wiki.games.example.org", "/chess/openings", 0),
    ("parks.city.info", "/opening-hours", 0),
    ("council.city.info", "/services/recycling", 0),
    ("music.example.net", "/concerts/spring-season", 0),
    ("astronomy.example.com", "/planets/saturn/rings", 0),
    ("help.software.example.org", "/manual/getting-started", 0),
    ("trains.example.net", "/timetable/night-train", 0),
    ("radio.example.com", "/de/programm/heute", 0),
    ("birds.example.org", "/species/kingfisher", 0),
    ("law.example.net", "/statutes/1998/chapter-4", 0),
    ("www.example.com", "/en/12", 0),
    ("m.example.org", "/de/404.html", 0),
    ("blog.example.net", "/fr/88/", 0),
    ("example.com", "/", 0),
    ("www.example.net", "/es/7", 0),
    ("news.example.org", "/en/676", 0),
    ("shop.example.com", "/en/product/31", 0),
    ("en.example.net", "/index.html", 0),
    ("static.example.org", "/img/logo.png", 0),
    ("city.info", "/about", 0),
    ("forum.example.com", "/thread/980", 0),
    ("docs.example.net", "/v2/api", 0),
)


def grams(text: str, salt: int) -> list[int]:
    c = [ord(x) for x in text]
    return [(salt + sum(f * c[i + k] for k, f in enumerate(FACTORS))) % BUCKETS for i in range(len(c) - GRAM + 1)]


@cache
def model(labelled: tuple = LABELLED, rounds: int = 400, rate: float = 1.0, decay: float = 1e-3) -> tuple[int, tuple[int, ...]]:
    """(bias, weights), integers: a URL is blocked if the mean weight of its grams and the bias add up to more than 0.

    Full-batch gradient descent; no randomness. Grams count SPREAD times their share, which only conditions the descent.
    """
    rows = [(found := grams(f"^{h}$", HOST_SALT) + grams(f"^{p}$", PATH_SALT), SPREAD / len(found), y) for h, p, y in labelled]
    bias, weights = 0.0, [0.0] * BUCKETS
    for _ in range(rounds):
        step, step_bias = [decay * w for w in weights], 0.0
        for found, x, y in rows:
            error = (1 / (1 + math.exp(-bias - x * sum([weights[g] for g in found]))) - y) / len(rows)
            step_bias += error
            for g in found:
                step[g] += error * x
        bias -= rate * step_bias
        weights = [w - rate * s for w, s in zip(weights, step)]
    return round(bias * SCALE), tuple(round(w * SPREAD * SCALE) for w in weights)


def scored(text: Column, salt: int, weights: Column) -> Column:
    """The sum of the weights of a text's grams, in one pass over its characters."""
    chars = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    n = F.size(chars) - GRAM + 1
    hashed = F.zip_with(
        F.zip_with(F.slice(chars, F.lit(1), F.greatest(n, F.lit(0))), F.slice(chars, F.lit(2), F.greatest(n, F.lit(0))), lambda a, b: a * FACTORS[0] + b * FACTORS[1]),
        F.zip_with(F.slice(chars, F.lit(3), F.greatest(n, F.lit(0))), F.slice(chars, F.lit(4), F.greatest(n, F.lit(0))), lambda a, b: a * FACTORS[2] + b * FACTORS[3]),
        lambda a, b: F.get(weights, ((a + b + salt) % BUCKETS).cast("int")).cast("long"),
    )
    return F.aggregate(hashed, F.lit(0).cast("long"), lambda a, x: a + x)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """Per row: id, host, path, rule (host and path of the rule that fits, else null), verdict, score (of the model).

    Null URLs and those without :// have empty host and path, so no grams: score 0, allowed. Very
    long URLs cost time in proportion. Repeated rows get the same verdict; an empty table gives an empty one. Only two
    columns are read, so others' names cannot clash.
    """
    bias, weights = model()
    host, path = url_parts(F.col("url"))
    out = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is tried first
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    table = F.array(*(F.lit(w) for w in weights))
    n = F.greatest(F.length("host") + 2 - GRAM + 1, F.lit(0)) + F.greatest(F.length("path") + 2 - GRAM + 1, F.lit(0))
    mark = lambda c: F.concat(F.lit("^"), F.col(c), F.lit("$"))
    score = scored(mark("host"), HOST_SALT, table) + scored(mark("path"), PATH_SALT, table) + F.lit(bias) * n
    out = out.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), score.cast("long").alias("score"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")


def sql() -> str:
    bias, weights = model()
    case = lambda pick: " ".join(f"WHEN (host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}') THEN '{pick(r)}'" for r in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r)))
    return f"""
WITH m AS (SELECT [{', '.join(map(str, weights))}]::BIGINT[] AS w),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
gr AS (SELECT page_id, host, path, unnest(list_concat(
         [[{HOST_SALT}, unicode(substr('^' || host || '$', i, 1)), unicode(substr('^' || host || '$', i + 1, 1)), unicode(substr('^' || host || '$', i + 2, 1)), unicode(substr('^' || host || '$', i + 3, 1))] for i in range(1, length(host))],
         [[{PATH_SALT}, unicode(substr('^' || path || '$', i, 1)), unicode(substr('^' || path || '$', i + 1, 1)), unicode(substr('^' || path || '$', i + 2, 1)), unicode(substr('^' || path || '$', i + 3, 1))] for i in range(1, length(path))], [[0]])) AS g FROM p),
s0 AS (SELECT page_id, host, path, sum(CASE WHEN len(g) = 5 THEN list_extract((SELECT w FROM m), 1 + (g[1]::BIGINT + {' + '.join(f'{f} * g[{k + 2}]::BIGINT' for k, f in enumerate(FACTORS))}) % {BUCKETS}) ELSE 0 END) AS total FROM gr GROUP BY page_id, host, path),
s AS (SELECT page_id, host, path, total + {bias} * (greatest(0, length(host) - 1) + greatest(0, length(path) - 1)) AS score FROM s0)
SELECT page_id, host, path, CASE {case(lambda r: r[0] + r[1])} END AS rule, coalesce(CASE {case(lambda r: r[2])} END, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict, score::BIGINT AS score FROM s
"""
