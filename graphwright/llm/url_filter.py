"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Rules label the urls that they fit; the trees are trained from those labels (at most `max_rows` of them, the first in the order of their
hashes, a bound on the fit alone), and judge the urls that no rule fits. Features: lengths of url, host and path, depth, labels of the
host, share of digits, hyphens, entropy of the characters, counts of parameters and fragments, and of the host's last label
how many other labelled urls it has and which share of them is blocked, smoothed. The trees are turned into CASE expressions, so that judging is
plain SQL. Everything runs in DataFrame functions and Spark's own tree learner.

Contract of judged(): host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path from there up to `?`, `#` or the end; both
empty for null urls and those without `://`. A rule fits its host and its subdomains if the path starts with the rule's; the
longest wins. If the labels are of one kind only, that is the verdict for all; without labels, allow. One row per input row.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import settled
from .native import join_small

#: (host, path, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
MAX_ROWS = 20_000
TREES, DEPTH, SEED = 12, 3, 7
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = ("n_url", "n_host", "n_path", "depth", "labels", "digits", "hyphens", "entropy", "params", "fragment", "suffix_n", "suffix_blocked")


def parts(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def rule_of(host: Column, path: Column, rules: tuple) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits per character of the text's own distribution."""
    n = F.length(text)

    def bits(c: Column) -> Column:
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -p * F.log2(p)

    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: acc + F.when(c == "", 0.0).otherwise(bits(c)))).otherwise(0.0)


def lexical(df: DataFrame, url: str) -> DataFrame:
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    count = lambda x, c: (F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))).cast("double")
    named = {
        "n_url": F.length(text).cast("double"),
        "n_host": F.length("__host").cast("double"),
        "n_path": F.length("__path").cast("double"),
        "depth": count(F.col("__path"), "/"),
        "labels": count(F.col("__host"), "."),
        "digits": F.coalesce(F.try_divide(F.length(F.regexp_replace(text, "[^0-9]", "")), F.length(text)), F.lit(0.0)),
        "hyphens": count(text, "-"),
        "entropy": entropy(text),
        "params": count(text, "="),
        "fragment": count(text, "#"),
    }
    return df.select("*", *(c.cast("double").alias(f"f_{n}") for n, c in named.items()), F.substring_index("__host", ".", -1).alias("__suffix"))


def tree_sql(node) -> str:
    """One tree as SQL."""
    if "Leaf" in node.getClass().getSimpleName():
        return f"{float(node.prediction())!r}D"
    split = node.split()
    return f"CASE WHEN f_{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D THEN {tree_sql(node.leftChild())} ELSE {tree_sql(node.rightChild())} END"


def boosted(labelled: DataFrame, trees: int, depth: int, seed: int) -> str:
    """SQL of the trees' weighted sum over the columns f_*; over 0 means block."""
    rows = VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features").transform(labelled)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features").fit(rows)
    return " + ".join(f"{float(w)!r}D * ({tree_sql(t._call_java('rootNode'))})" for t, w in zip(model.trees, model.treeWeights, strict=True))


def judged(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules: tuple = RULES, max_rows: int = MAX_ROWS, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of the trees; over 0 means block)."""
    df = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("__url"))
    host, path = parts(F.col("__url"))
    df = df.select("*", host.alias("__host"), path.alias("__path"))
    df = lexical(df.select("*", rule_of(F.col("__host"), F.col("__path"), rules).alias("__rule")), "__url")
    block = (F.col("__rule.verdict") == "block").cast("double")
    suffixes = df.where("__rule is not null").groupBy("__suffix").agg(F.count("*").alias("n"), F.sum(block).alias("n_blocked"))
    df = join_small(df, suffixes, ["__suffix"], F.col("page_id"))
    # a labelled url is left out of its own suffix's counts, so that no label is a feature of itself
    own = F.col("__rule").isNotNull().cast("long")
    n, n_blocked = F.coalesce("n", F.lit(0)) - own, F.coalesce("n_blocked", F.lit(0.0)) - F.coalesce(block, F.lit(0.0)) * own
    df = df.select("*", F.log1p(n).alias("f_suffix_n"), ((n_blocked + 1) / (n + 2)).alias("f_suffix_blocked"))
    labelled = df.where("__rule is not null").select(*(f"f_{f}" for f in FEATURES), block.alias("label"), F.xxhash64("__url").alias("__h"), "page_id")
    sample = settled(labelled.orderBy("__h", "page_id").limit(max_rows))
    kinds = [r[0] for r in sample.select("label").distinct().collect()]
    if len(kinds) == 2:
        score = F.expr(boosted(sample, trees, depth, seed))
    else:
        score = F.lit(1.0 if kinds == [1.0] else -1.0)
    verdict = F.coalesce("__rule.verdict", F.when(score > 0, "block").otherwise("allow"))
    return df.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), score.alias("score"))
