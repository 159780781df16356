"""URL filters: host and path rules, then boosted trees over lexical features.

The rules label the URLs that they fit; trees trained on those judge the rest.
"""

import pyspark.sql.functions as F
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from tollwatch.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Verdict, host and path of each rule.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"),
         ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy",
            "params", "hyphens", "secure", "fragment", "suffix_share", "suffix_seen"]


def with_parts(df, url="url"):
    """Adds host and path: what stands between the first ``://`` and ``?`` or ``#``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return df.withColumns({"host": host, "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def with_rule(df, rules=RULES):
    """Adds the longest rule that fits host and path, and its verdict; null where none fits.

    Rules are a short list written by people; of two equally long ones the
    first listed wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        found = F.when(fits & F.col("path").startswith(path), F.struct(
            F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return df.withColumn("ruled", found)


def lexical(df, url="url"):
    """Adds the lexical features that need no training, and the host's suffix."""
    u = F.coalesce(F.col(url), F.lit(""))
    size = F.greatest(F.length(u), F.lit(1))

    def share(c):
        return (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / size

    letters = F.array_distinct(F.split(u, ""))
    entropy = F.aggregate(F.transform(F.filter(letters, lambda c: c != ""), lambda c: (
        -share(c) * F.log2(share(c)))), F.lit(0.0), lambda a, b: a + b)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return df.withColumns({
        "length": F.length(u).cast("double"), "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"),
        "digit_ratio": F.length(F.regexp_replace(u, "[^0-9]", "")) / size,
        "entropy": entropy,
        "params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
        "hyphens": F.length(F.regexp_replace("host", "[^-]", "")).cast("double"),
        "secure": F.lower(u).startswith("https:").cast("double"),
        "fragment": u.contains("#").cast("double"),
        "suffix": F.substring_index("host", ".", -1),
    })


def fit_urls(df, rules=RULES, bound=20_000, url="url", trees=20, depth=4):
    """(suffix statistics, model) from at most ``bound`` of the URLs that rules label.

    URLs are taken in the order of a hash, each once. The statistics are the
    share of allowed ones, drawn towards one half, and how many there were, for
    each suffix of the sample. The model is a share where a label is missing.
    """
    known = with_rule(with_parts(df.select(F.col(url).alias("url")).where(F.col(url).isNotNull())),
                      rules).where("ruled is not null")
    sample = known.groupBy("url").agg(F.first("host").alias("host"), F.first("path").alias("path"),
                                      F.max("ruled.verdict").alias("verdict"))
    sample = lexical(sample.orderBy(F.xxhash64("url"), "url").limit(bound)).withColumn(
        "label", (F.col("verdict") == "allow").cast("double"))
    sample = written(sample, "url-sample")
    suffixes = sample.groupBy("suffix").agg(
        ((F.sum("label") + 1) / (F.count("*") + 2)).alias("suffix_share"),
        F.log1p(F.count("*").cast("double")).alias("suffix_seen"))
    n, allowed = sample.agg(F.count("*"), F.sum("label")).first()
    if not n or allowed in (0.0, float(n)):
        return suffixes, (float(allowed or 0) + 1) / (n + 2)
    rows = _vectors(sample, suffixes).select("features", "label").coalesce(4)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, maxBins=32).fit(rows)
    return suffixes, model


def _vectors(df, suffixes):
    # one row per suffix of the bounded sample, so this side is small
    seen = df.join(F.broadcast(suffixes), "suffix", "left").fillna(
        {"suffix_share": 0.5, "suffix_seen": 0.0})
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(seen)


def judge_urls(df, fitted, rules=RULES, threshold=0.5, url="url", key="page_id"):
    """key, host, path, rule, verdict and score for each row.

    The verdict is the rule's where one fits, else ``allow`` if the trees score
    the URL at ``threshold`` or more. A null URL, or one without ``://``, has
    an empty host and path and is scored by what is left of it. Repeated rows
    are judged alike; other columns are not looked at.
    """
    suffixes, model = fitted
    own = df.select(F.col(key).alias("page"), F.col(url).alias("url"))
    own = lexical(with_rule(with_parts(own), rules))
    if isinstance(model, float):
        scored = own.withColumn("score", F.lit(model))
    else:
        scored = model.transform(_vectors(own, suffixes)).withColumn(
            "score", vector_to_array("probability")[1])
    learned = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select(
        F.col("page").alias(key), "host", "path", F.col("ruled.rule").alias("rule"),
        F.coalesce("ruled.verdict", learned).alias("verdict"), "score")
