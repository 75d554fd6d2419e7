"""URL filters: fixed rules first, a logistic regression on character n-grams for the rest.

Rules name a host and a path prefix; a rule fits its host and all its subdomains, and the longest fitting rule decides.
Other URLs are judged by a logistic regression over hashed character n-grams of host and path. It is fitted on a small
labelled table, by default ``LABELLED``, with Spark's own estimator; features are built by SQL functions. Both verdicts are
about equally frequent in that table but not among pages, so a URL is blocked only at a probability above ``BLOCK_ABOVE``.

Defined cases: a null URL and one without ``://`` have an empty host and path and no n-gram, so the intercept decides, by default
allow; a labelled table without both verdicts gives allow for all that no rule fits. URLs of any length are read whole.
Repeated rows are judged alike; an empty table gives an empty result. Further columns pass through.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystar.llm.shared import positional

GRAMS = (3, 4, 5)
BUCKETS = 1 << 14
REGULARIZATION = 0.003
BLOCK_ABOVE = 0.8

# The labelled URLs are made by a rule from these words: hosts of one and two words under several top-level domains and
# prefixes that both classes share, each with a path of its class and a path that says nothing. 1 blocks, 0 allows.
_BLOCKED_WORDS = (
    "casino poker bets jackpot slots roulette bingo gambling spins viagra pills meds pharma steroids adult xxx porn cams "
    "escort hookup torrent warez crack keygen nulled loan payday cash prize lottery giveaway replica cheap discount free "
    "spam farm seo links clicks tracker track ads banner popup phish malware hack"
).split()
_ALLOWED_WORDS = (
    "news library garden weather university museum cooking history mathematics travel science health theatre railway "
    "software music town council book data school research journal archive kitchen mountain river history language "
    "painting theory engineering gardening planet reading writing teaching nation thinking shelter other station "
    "letters northern weaver brother tradition attention anthem"
).split()
_BLOCKED_PATHS = ["/win/bonus", "/signup-now/offer.php", "/buy/cheap/", "/download/crack.zip", "/go/click", "/xxx/gallery"]
_ALLOWED_PATHS = ["/articles/2021/05/", "/about/people", "/docs/index.html", "/wiki/Main_Page", "/blog/post-17", "/news/local/"]
_PATHS = ["/en/12", "/fr/345.html", "/de/67/", "/es/890", "/", ""]
_DOMAINS = ["com", "org", "net", "info", "biz", "to"]
_PREFIXES = ["", "www.", "m.", "blog.", ""]


def _labelled(words: list[str], paths: list[str], block: int) -> list[tuple[str, int]]:
    rows = []
    for i, word in enumerate(words):
        for k, other in enumerate([None, words[(i + 1) % len(words)], words[(i + 7) % len(words)]]):
            name = word if other is None else f"{word}{'-' if (i + k) % 2 else ''}{other}"
            host = f"{_PREFIXES[(i + 2 * k) % len(_PREFIXES)]}{name}.{_DOMAINS[(i + k) % len(_DOMAINS)]}"
            rows += [(f"https://{host}{paths[(i + k) % len(paths)]}", block), (f"http://{host}{_PATHS[(i + 3 * k) % len(_PATHS)]}", block)]
    return rows


LABELLED = _labelled(_BLOCKED_WORDS, _BLOCKED_PATHS, 1) + _labelled(_ALLOWED_WORDS, _ALLOWED_PATHS, 0)

Rule = tuple[str, str, str]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest of the rules (verdict, host, path) that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, action).otherwise(verdict)
    return name, verdict


def _grams(host: Column, path: Column) -> Column:
    def cut(kind: str, text: Column, n: int) -> Column:
        padded = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))))
        grams = F.transform(starts, lambda at: F.concat(F.lit(kind), F.substring(padded, at, F.lit(n))))
        return F.coalesce(grams, F.array().cast("array<string>"))
    return F.concat(*[cut(kind, text, n) for kind, text in (("h", host), ("p", path)) for n in GRAMS])


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(url).alias("url"), F.lit(float(block)).alias("block")) for url, block in LABELLED])
    return spark.range(1).select(F.inline(rows))


def fit(labelled: DataFrame):
    """The fitted model, or None where the table lacks one of the verdicts."""
    rows = labelled.where("url is not null and block is not null").select("url", F.col("block").cast("double").alias("label"))
    if rows.select("label").distinct().count() < 2:
        return None
    rows = _tf().transform(rows.withColumn("grams", _grams(*url_parts(F.col("url")))))
    return LogisticRegression(featuresCol="features", labelCol="label", regParam=REGULARIZATION, maxIter=100).fit(rows)


def _tf() -> HashingTF:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=BUCKETS, binary=True)


def judge(pages: DataFrame, labelled: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """The pages as c0, c1, … with host, path, rule, block_probability and verdict."""
    frame, names = positional(pages, url)
    host, path = url_parts(F.col(names[url]))
    rows = frame.withColumn("host", host).withColumn("path", path)
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", ruled)
    model = fit(labelled)
    if model is None:
        scored = rows.withColumn("block_probability", F.lit(0.0))
    else:
        model = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("chance")
        scored = model.transform(_tf().transform(rows.withColumn("grams", _grams(F.col("host"), F.col("path")))))
        scored = scored.withColumn("block_probability", vector_to_array("chance")[1]).drop("grams", "features", "chance")
    learned = F.when(F.col("block_probability") > BLOCK_ABOVE, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("ruled", learned)).drop("ruled")
