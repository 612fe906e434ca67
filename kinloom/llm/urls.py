"""URL filter: listed rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs; by default these are the URLs that a rule decides. Suffix
statistics (how often URLs of a host suffix were blocked) come from all labelled rows; the
trees are fitted on a bounded sample of them and applied to every URL, all in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.session import Scratch

# The rules, (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SAMPLE_ROWS = 20_000  # labelled URLs the trees are fitted on, at most about so many
TREES, DEPTH = 10, 3
SMOOTHING = 20.0
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for a url without ://; capitals of the host A-Z become small."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, CAPITALS, SMALL), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule covers its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, of_host, of_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(of_path)
        rule = F.when(fits, F.lit(of_host + of_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical measures of one URL, doubles; a null URL counts as empty."""
    url = F.coalesce(url, F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    bits = F.transform(F.array_distinct(F.split(url, "")), lambda c: F.when(c == "", 0.0).otherwise(-share(c) * F.log2(share(c))))
    return {
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "depth": _count(path, "/[^/]"),
        "labels": _count(host, r"[^.]+"),
        "hyphens": _count(host, "-"),
        "digit_ratio": _count(url, "[0-9]") / size,
        "entropy": F.aggregate(bits, F.lit(0.0), lambda a, x: a + x),
        "parameters": _count(url, "[?&][^=&#]+="),
        "fragment": _count(url, "#"),
        "secure": url.startswith("https").cast("double"),
        "directory": F.length(F.regexp_extract(path, r"^/([^/]*)", 1)).cast("double"),
        "file_suffix": F.length(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)).cast("double"),
    }


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """What suffix statistics are kept for: the last label of the host, its last two, and the first folder of the path."""
    return {
        "top": F.regexp_extract(host, r"[^.]*$", 0),
        "site": F.regexp_extract(host, r"[^.]*\.?[^.]*$", 0),
        "folder": F.regexp_extract(path, r"^/[^/]*", 0),
    }


@dataclass
class UrlModel:
    trees: GBTClassificationModel | None  # None: labels of one kind only, or none
    default: float  # share blocked among the labelled
    statistics: dict[str, DataFrame]
    assembler: VectorAssembler


def _described(urls: DataFrame) -> DataFrame:
    """`urls` (url and whatever else) with host, path, features (f_) and suffixes (s_)."""
    host, path = host_and_path(F.col("url"))
    split = urls.withColumns({"__host": host, "__path": path})
    host, path = F.col("__host"), F.col("__path")
    return split.withColumns(
        {f"f_{k}": c for k, c in features(F.col("url"), host, path).items()} | {f"s_{k}": c for k, c in suffixes(host, path).items()}
    )


def _with_statistics(described: DataFrame, statistics: dict[str, DataFrame], default: float) -> DataFrame:
    out = described
    for name, table in statistics.items():
        rate = (F.coalesce("__blocked", F.lit(0)) + SMOOTHING * default) / (F.coalesce("__seen", F.lit(0)) + SMOOTHING)
        out = (
            out.join(table, f"s_{name}", "left")
            .withColumns({f"f_{name}_rate": rate, f"f_{name}_seen": F.log1p(F.coalesce("__seen", F.lit(0)))})
            .drop("__blocked", "__seen")
        )
    return out


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> UrlModel:
    """Trees from `labelled` (url, label: 1 to block). Null labels are ignored; null URLs count as empty."""
    scratch = Scratch(labelled.sparkSession, "urls")
    described = scratch.put(_described(labelled.select("url", F.col("label").cast("double").alias("label")).filter("label is not null")), "labelled")
    count, blocked = described.agg(F.count("*"), F.sum("label")).first()
    default = (blocked or 0.0) / max(count, 1)
    statistics = {
        k: scratch.put(described.groupBy(f"s_{k}").agg(F.count("*").alias("__seen"), F.sum("label").alias("__blocked")), f"suffix_{k}")
        for k in suffixes(F.lit(""), F.lit(""))
    }
    sample = described.sample(min(1.0, sample_rows / max(count, 1)), seed=10)
    ready = scratch.put(_with_statistics(sample, statistics, default), "sample")
    assembler = VectorAssembler(inputCols=sorted(c for c in ready.columns if c.startswith("f_")), outputCol="__features")
    kinds = ready.select(F.count_distinct("label")).first()[0]
    trees = None
    if kinds == 2:
        learner = GBTClassifier(
            featuresCol="__features", labelCol="label", predictionCol="__blocked", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=10
        )
        trees = learner.fit(assembler.transform(ready))
    return UrlModel(trees, default, statistics, assembler)


def judge(urls: DataFrame, model: UrlModel) -> DataFrame:
    """`urls` (a column url, and ids to keep) with `blocked`, the model's verdict on each URL."""
    kept = urls.columns
    ready = _with_statistics(_described(urls), model.statistics, model.default)
    if model.trees is None:
        return ready.select(*kept, F.lit(model.default > 0.5).alias("blocked"))
    scored = model.trees.transform(model.assembler.transform(ready))
    return scored.select(*kept, (F.col("__blocked") > 0.5).alias("blocked"))


def filter_urls(pages: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per row of `pages`; ids are passed through, null or repeated."""
    host, path = host_and_path(F.col("url"))
    rule, verdict = ruled(host, path)
    label = (verdict == "block").cast("int")
    model = train(pages.select("url", label.alias("label")), sample_rows)
    judged = judge(pages.select("page_id", "url"), model)
    host, path = host_and_path(F.col("url"))
    rule, verdict = ruled(host, path)
    learned = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"))
