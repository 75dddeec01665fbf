"""URL filters: host and path rules, then logistic regression on hashed character n-grams.

DataFrame functions only. The model is trained on a small labelled table of URLs; the rules are
data (host, path prefix, verdict) and the longest that fits wins.

Defined results: a null URL, or one without ``://``, has an empty host and an empty path, fits no
rule and is judged by the model on its bias alone. Repeated rows get equal results. Columns of
``pages`` other than ``page_id`` and ``url`` are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_BUCKETS = 1024
GRAMS = (3, 4)
#: (host, path prefix, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
# The labelled table is built from these fixed words: spam hosts join two of the first list, clean
# hosts are words of the second; both get the same prefixes, domains and common paths.
_SPAM = ("casino", "bets", "poker", "pills", "adult", "xxx", "spam", "ads", "track", "win", "free", "cheap", "farm", "loans", "cams")
_CLEAN = ("library", "news", "city", "docs", "wiki", "garden", "weather", "maths", "museum", "forum", "health", "history", "river", "therapy", "nation", "thing", "other", "there", "earth", "northern", "city-news", "open-data", "bird-notes", "anthem", "motion", "lessons")
_PREFIX = ("", "www.", "blog.", "m.")
_DOMAIN = ("example.com", "example.net", "example.org", "com", "net", "org")
_PATH = ("/en/12", "/de/340", "/fr/7/", "/es/98.html", "/articles/2020/rivers", "/", "")
_SPAM_PATH = ("/bet/now", "/xxx/9", "/ads/click.php", "/win-cash")


def labelled_urls() -> list[tuple[str, int]]:
    """The training table: 1 marks a URL to block."""
    spam = [f"{a}-{b}" if (i + j) % 3 else f"{a}{b}" for i, a in enumerate(_SPAM) for j, b in enumerate(_SPAM) if a != b and (i + 2 * j) % 3 == 0]
    rows = []
    for label, hosts, paths in ((1, spam, _PATH), (0, [w for w in _CLEAN for _ in range(3)], _PATH), (1, _CLEAN[:8], _SPAM_PATH)):
        for i, host in enumerate(hosts):
            rows.append((f"http://{_PREFIX[i % 4]}{host}.{_DOMAIN[(i // 2) % 6]}{paths[i % len(paths)]}", label))
    return rows


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path without query and fragment."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _grams(part: Column, mark: str, n: int) -> Column:
    size = F.char_length(part)
    at = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
    gram = lambda i: F.concat(F.lit(mark), F.substring(part, i, F.lit(n)))
    return F.transform(at, lambda i: F.pmod(F.xxhash64(gram(i)), F.lit(N_BUCKETS)).cast("int"))


def _buckets(host: Column, path: Column) -> Column:
    """Hash buckets of the n-grams of host and of path, marked by where they stand; all digits count as 0."""
    ends = F.lit("$")
    host, path = (F.translate(x, "123456789", "000000000") for x in (host, path))
    parts = [(F.concat(F.lit("^"), host, ends), "h"), (F.concat(path, ends), "p")]
    return F.array_distinct(F.concat(*[_grams(part, mark, n) for part, mark in parts for n in GRAMS]))


def train(spark: SparkSession, labelled: DataFrame | None = None) -> tuple[list[float], float]:
    """Weights of the buckets and the bias, from (url, label) rows."""
    rows = labelled if labelled is not None else spark.createDataFrame(labelled_urls(), "url string, label int")
    host, path = host_path(F.col("url"))
    bag = _buckets(F.col("host"), F.col("path"))
    dense = array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(N_BUCKETS - 1)), lambda b: F.array_contains(F.col("bag"), b).cast("double")))
    x = rows.select(F.col("label").cast("double").alias("label"), host.alias("host"), path.alias("path")).withColumn("bag", bag).select("label", dense.alias("features"))
    model = LogisticRegression(regParam=0.003, maxIter=60, standardization=False).fit(x)
    return [float(w) for w in model.coefficients], float(model.intercept)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (its host and path as text) and its verdict; null where none fits."""
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is applied last
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        best, verdict = F.when(fits, h + p).otherwise(best), F.when(fits, v).otherwise(verdict)
    return best, verdict


def judge(pages: DataFrame, weights: list[float], bias: float, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every URL."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    table = F.array(*[F.lit(w) for w in weights])
    total = F.aggregate(_buckets(F.col("host"), F.col("path")), F.lit(bias), lambda s, b: s + F.element_at(table, b + 1))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    scored = rows.withColumn("score", 1 / (1 + F.exp(-total))).withColumn("rule", rule).withColumn("ruled", verdict)
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
