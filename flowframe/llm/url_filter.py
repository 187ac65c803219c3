"""URL filter: host and path rules first, boosted trees on lexical features for the rest.

DataFrame functions and MLlib only. The trees are trained on labelled URLs: those that a
rule decides, and those that a labelled source knows. Without such a source a block list
stands in for it: a host with a listed word is labelled block, any other allow, as nothing
else tells of clean hosts that no rule knows; families on no list are then let through. Features are lengths,
depth, counts, shares of digits, character entropy and statistics of the host's suffix.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, sample_fraction, settle

#: Labelled URLs of each verdict that the trees are fitted on.
TRAIN_PER_VERDICT = 4_000
TREES, DEPTH, SEED = 12, 4, 7
#: Words in a host that label it as blocked when no rule decides, chosen by us.
BLOCK_WORDS = ("spam", "pills", "casino", "viagra", "porn", "xxx", "warez", "payday")
#: The same, but only as whole words between dots and hyphens, as they are part of harmless words.
BLOCK_NAMES = ("ads", "adult", "bet", "bets", "betting", "gambling", "poker", "sex", "tracker", "tracking")


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # host, a slash, and the start of the path

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.text.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)


#: The rules of the contract.
RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, its A-Z lower-cased, and the path after it; empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def _entropy(text: Column) -> Column:
    """Bits per character; once over the distinct ones."""
    n = F.length(text)

    def part(c: Column) -> Column:
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -p * F.log2(p)

    return F.when(n > 0, F.aggregate(F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", 0.0).otherwise(part(c))), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def _share(text: Column, pattern: str) -> Column:
    return F.when(F.length(text) > 0, 1 - F.length(F.regexp_replace(text, pattern, "")) / F.length(text)).otherwise(0.0)


def features(url: Column, host: Column, path: Column, rate: Column, share: Column) -> dict[str, Column]:
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    count = lambda text, what: F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))
    got = {
        "url_length": F.length(F.coalesce(url, F.lit(""))), "host_length": F.length(host), "path_length": F.length(path), "depth": count(path, "/"), "labels": count(host, "."),
        "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))), F.lit(0)),
        "hyphens": count(host, "-"), "host_digits": _share(host, "[0-9]"), "path_digits": _share(path, "[0-9]"), "host_entropy": _entropy(host), "path_entropy": _entropy(path),
        "params": F.when(query == "", 0).otherwise(count(query, "&") + 1), "query_length": F.length(query), "fragment": F.coalesce(url.contains("#"), F.lit(False)), "secure": F.coalesce(url.startswith("https"), F.lit(False)),
        "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$"), "suffix_rate": rate, "suffix_share": share,
    }
    return {f"x_{k}": v.cast("double") for k, v in got.items()}


def block_list(host: Column, words: tuple[str, ...] = BLOCK_WORDS, names: tuple[str, ...] = BLOCK_NAMES) -> Column:
    """``block`` for hosts with a listed word in them, or a listed name between dots and hyphens, else ``allow``."""
    listed = F.arrays_overlap(F.split(host, "[.-]"), F.array(*[F.lit(w) for w in names]).cast("array<string>"))
    for w in words:
        listed = listed | host.contains(w)
    return F.when(listed, "block").otherwise("allow")


def apply_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", more: dict[str, Column] | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, *more) per row; rule and verdict of the longest fitting rule, null where none fits."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), *[c.alias(k) for k, c in (more or {}).items()])
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the longest is asked first
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rows.withColumns({"rule": rule, "verdict": verdict})


def judge(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", per_verdict: int = TRAIN_PER_VERDICT, trees: int = TREES, depth: int = DEPTH,
    known: Column | None = None, learn: Column | None = None,
) -> DataFrame:
    """(id, host, path, rule, verdict, score double) per row: the longest fitting rule's verdict, or that of the trees.

    ``known`` is a column of ``pages`` with the label that a source has for a URL, ``block``
    or ``allow``; URLs with a null there are not trained on. By default it is the block
    list's. ``learn`` says which rows may be trained on, all by default. ``score`` is the
    trees' probability of a block, null where a rule decides. Null URLs and those without
    ``://`` have an empty host and path. Where the labelled URLs are all of one verdict
    there is nothing to learn and the rest get that verdict, or ``allow`` when there are
    none. Repeated and null ids yield a row each, URLs of any length are read whole, an
    empty table gives no rows. Other columns are not read.
    """
    given = F.lit(None).cast("string") if known is None else known.cast("string")
    rows = apply_rules(pages, rules, id_col, url_col, {"given": given, "learn": F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))})
    if known is None:
        rows = rows.withColumn("given", block_list(F.col("host")))
    told = F.coalesce("verdict", "given")
    label = F.when(told == "block", 1.0).when(told == "allow", 0.0)
    labelled = rows.where("learn").select("page_id", "url", "host", "path", "rule", label.alias("label")).where("label is not null")
    sizes = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        rest = "block" if 1.0 in sizes else "allow"
        return rows.select(F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(rest)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    # by row, as one URL may be a large part of all rows; weights give each verdict its share of all labelled rows again
    few = F.lit(False)
    for k in sizes:
        few = few | ((F.col("label") == k) & sample_fraction(F.struct("page_id", "url"), per_verdict / sizes[k]))
    sample = settle(labelled.where(few).coalesce(2))
    drawn = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = F.lit(0.0)
    for k, n in drawn.items():
        weight = F.when(F.col("label") == k, F.lit(sizes[k] / n * sum(drawn.values()) / sum(sizes.values()))).otherwise(weight)
    suffix = F.substring_index("host", ".", -1)
    # rates come from what rules decide, as block words say little of a suffix
    ruled = F.col("verdict").isNotNull()
    stats = rows.groupBy(suffix.alias("suffix")).agg(F.count("*").alias("n"), F.sum(ruled.cast("long")).alias("ruled"), F.sum((F.col("verdict") == "block").cast("long")).alias("blocked"))
    stats = settle(stats)
    total, base = stats.agg(F.sum("n")).first()[0], sizes[1.0] / sum(sizes.values())
    stats = stats.select("suffix", (F.col("n") / total).alias("share"), F.when(F.col("ruled") > 0, (F.col("blocked") + 1) / (F.col("ruled") + 2)).otherwise(base).alias("rate"))
    stats = broadcast_if_small(stats)
    made = features(F.col("url"), F.col("host"), F.col("path"), F.col("rate"), F.col("share"))
    of_suffix = lambda df: df.withColumn("suffix", suffix).join(stats, "suffix").withColumns(made)
    gather = VectorAssembler(inputCols=list(made), outputCol="features")
    train = gather.transform(of_suffix(sample.withColumn("weight", weight))).select("features", "label", "weight")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=SEED, stepSize=0.3, maxMemoryInMB=64, weightCol="weight").fit(train)
    from pyspark.ml.functions import vector_to_array

    rest = model.transform(gather.transform(of_suffix(rows.where("verdict is null"))))
    rest = rest.select("page_id", "host", "path", "rule", F.when(F.col("prediction") == 1, "block").otherwise("allow").alias("verdict"), vector_to_array("probability")[1].alias("score"))
    out = rows.where("verdict is not null").select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("score")).unionByName(rest)
    return out.withColumnRenamed("page_id", id_col)
