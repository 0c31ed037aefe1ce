"""Operator 6, URL filters: rules first, else boosted trees on lexical features.

Native: DataFrame functions only, training included. A rule is a host suffix and a path
prefix, which begins with ``/`` (so ``http://a.net``, whose path is empty, fits no rule); of
the rules that fit a URL the longest decides. All other URLs are judged by
gradient-boosted regression trees on the logistic loss. Features are cut into bins by
fixed edges. Each level of a tree is one grouped sum of gradients by leaf,
feature and bin over the training rows; these sums, at most 2^DEPTH leaves times all
bins, come to the driver, which picks the best split of each leaf, and the finished
trees are CASE expressions.

Labelled URLs are a table (url, y), an argument of the operator. The test data has none,
so the query makes labels by a list of terms of hosts (``labelled``, which can also take
the rules' verdicts as labels; by default it does not, as rules that block one language
of a host teach the trees to block the host). The model sees no term or whole host, only
lexical features: lengths, depth, digit ratio, entropy, hyphens, parameters, and for the
suffix of the host its number of labelled URLs and their smoothed rate. These are counted over all labelled
URLs, without those of the URL's own fold of FOLDS, so no label reaches its own row. The
trees are fitted on at most TRAIN_ROWS different URLs, the first in the order of a hash
(a documented bound).

Defined results: a null URL or one without ``://`` has an empty host and path, fits no
rule and is judged by its features; repeated rows repeat, and count once as labels (the
larger label); without labels of both kinds everything that no rule fits is allowed;
URLs of any length are read whole; empty tables give no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BLOCK_TERMS = ("casino", "bets", "poker", "pills", "viagra", "spam", "adult", "porn", "ads-", "track", "malware", "phish", "warez")
TRAIN_ROWS, TREES, DEPTH, RATE, PENALTY, FOLDS = 20_000, 10, 2, 0.5, 1.0, 5
EDGES = {
    "url_length": (25, 30, 35, 40, 45, 50, 60, 80),
    "host_length": (8, 12, 14, 16, 18, 20, 22, 24, 26, 30),
    "depth": (1, 2, 3, 4, 6),
    "digit_ratio": (0.001, 0.02, 0.05, 0.08, 0.12, 0.2),
    "host_entropy": (2.0, 2.5, 2.75, 3.0, 3.25, 3.5, 3.75),
    "hyphens": (1, 2, 3),
    "labels": (2, 3, 4, 5),
    "longest_label": (5, 6, 7, 8, 9, 10, 12, 15),
    "vowel_ratio": (0.1, 0.2, 0.25, 0.3, 0.35, 0.4),
    "parameters": (1, 2, 3),
    "suffix_rate": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5),
    "suffix_count": (10, 100, 1000, 10_000),
}
PRIOR = 20.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: str, path: str, rules=RULES) -> Column:
    """The longest rule that fits, as it is written; null if none does."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, prefix = rule.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith("." + name)) & F.col(path).startswith("/" + prefix)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def lexical(pages: DataFrame) -> DataFrame:
    """Features of (url, host, path) but for those of the suffix; the suffix itself is a column."""
    entropy = F.expr(
        "aggregate(transform(array_distinct(split(host, '')), c -> size(filter(split(host, ''), d -> d = c)) / length(host)), 0D, (s, p) -> s - p * log2(p))"
    )
    n = lambda text, pattern: F.length(F.regexp_replace(text, pattern, ""))
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    return pages.withColumns({
        "url_length": F.length(url),
        "host_length": F.length("host"),
        "depth": n("path", "[^/]"),
        "digit_ratio": n(url, "[^0-9]") / F.greatest(F.length(url), F.lit(1)),
        "host_entropy": F.when(F.col("host") == "", F.lit(0.0)).otherwise(entropy),
        "hyphens": n("host", "[^-]"),
        "labels": F.size(F.split("host", "\\.")),
        "longest_label": F.array_max(F.transform(F.split("host", "\\."), F.length)),
        "vowel_ratio": n("host", "[^aeiou]") / F.greatest(F.length("host"), F.lit(1)),
        "parameters": F.when(query == "", F.lit(0)).otherwise(n(query, "[^&]") + 1),
        "suffix": suffix_of(F.col("host")),
        "fold": fold_of(url),
    })


def suffix_of(host: Column) -> Column:
    """What follows the first label of a host, or its last label where that would be the registered name."""
    return F.when(F.size(F.split(host, "\\.")) > 2, F.regexp_replace(host, "^[^.]*\\.", "")).otherwise(F.substring_index(host, ".", -1))


def fold_of(url: Column) -> Column:
    return F.pmod(F.crc32(url.cast("binary")), F.lit(FOLDS)).cast("int")


def labelled(pages: DataFrame, terms=BLOCK_TERMS, rules=()) -> DataFrame:
    """(url, y) of URLs with a host: 1 if a rule blocks it, 0 if one allows it, else 1 if the host has a term of the list."""
    host, path = host_and_path(F.col("url"))
    t = pages.select("url", host.alias("host"), path.alias("path")).where("host != ''")
    hit = F.lit(False)
    for x in terms:
        hit = hit | F.col("host").contains(x)
    told = F.create_map(*(F.lit(x) for r in rules for x in r))[rule_for("host", "path", rules)] if rules else F.lit(None).cast("string")
    return t.select("url", F.when(told.isNotNull(), told == "block").otherwise(hit).cast("int").alias("y"))


def binned() -> dict[str, Column]:
    """Each feature's bin: how many edges are not above it."""
    return {f"b_{k}": sum(((F.col(k) >= e).cast("int") for e in edges[1:]), (F.col(k) >= edges[0]).cast("int")) for k, edges in EDGES.items()}


def suffix_counts(labels: DataFrame) -> DataFrame:
    """(known, known_fold, s_block, s_n): of each suffix, over all labelled URLs but those of the fold."""
    host, _ = host_and_path(F.col("url"))
    cells = labels.groupBy(suffix_of(host).alias("known"), fold_of(F.col("url")).alias("known_fold")).agg(F.sum("y").alias("b"), F.count("*").alias("n"))
    total = cells.groupBy("known").agg(F.sum("b").alias("all_b"), F.sum("n").alias("all_n"))
    total = total.withColumn("known_fold", F.explode(F.array(*map(F.lit, range(FOLDS)))))
    t = total.join(cells, ["known", "known_fold"], "left")
    return t.select("known", "known_fold", (F.col("all_b") - F.coalesce("b", F.lit(0))).alias("s_block"), (F.col("all_n") - F.coalesce("n", F.lit(0))).alias("s_n"))


def with_suffix(t: DataFrame, suffixes: DataFrame, rate: float) -> DataFrame:
    t = t.join(suffixes, (t["suffix"] == suffixes["known"]) & (t["fold"] == suffixes["known_fold"]), "left")
    t = t.withColumn("suffix_rate", (F.coalesce("s_block", F.lit(0)) + PRIOR * rate) / (F.coalesce("s_n", F.lit(0)) + PRIOR))
    return t.withColumn("suffix_count", F.coalesce("s_n", F.lit(0)))


def best_splits(t: DataFrame, leaf: Column) -> dict[int, tuple]:
    """Of each leaf the best split: (gain, feature, bin, left value, right value), the largest of equals."""
    names = list(EDGES)
    t = t.select(leaf.alias("leaf"), "g", "h", *(f"b_{k}" for k in names))
    long = t.select("leaf", "g", "h", F.expr("stack({}, {}) as (feature, bin)".format(len(names), ", ".join(f"'{k}', b_{k}" for k in names))))
    cells = long.groupBy("leaf", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
    worth = lambda g, h: g * g / (h + PENALTY)
    value = lambda g, h: -RATE * g / (h + PENALTY)
    out: dict[int, tuple] = {}
    for k in {c.leaf for c in cells}:
        for name in names:
            own = sorted((c for c in cells if c.leaf == k and c.feature == name), key=lambda c: c.bin)
            all_g, all_h, g, h = sum(c.g for c in own), sum(c.h for c in own), 0.0, 0.0
            for c in own:
                g, h = g + c.g, h + c.h
                gain = worth(g, h) + worth(all_g - g, all_h - h) - worth(all_g, all_h)
                split = round(gain, 9), name, c.bin, value(g, h), value(all_g - g, all_h - h)
                out[k] = max(out.get(k, split), split)
    return out


def boost(t: DataFrame) -> Column:
    """The margin of the fitted trees as an expression over the bins; t: bins, y and weights w, balanced."""
    margin = F.lit(0.0)
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-F.col("margin")))
        own = t.withColumn("margin", margin).withColumns({"g": F.col("w") * (p - F.col("y")), "h": F.col("w") * p * (1 - p)})
        leaf, leaves = F.lit(0), {0: 0.0}
        for _level in range(DEPTH):
            nodes = best_splits(own, leaf)
            nxt, values = leaf * 2, {}
            for k in sorted(leaves):
                gain, feature, bin_, left, right = nodes.get(k, (0.0, "", 0, 0.0, 0.0))
                if gain > 0:
                    nxt = nxt + F.when((leaf == k) & (F.col(f"b_{feature}") > bin_), 1).otherwise(0)
                    values |= {2 * k: left, 2 * k + 1: right}
                else:
                    values[2 * k] = leaves[k]
            leaf, leaves = nxt, values
        step = F.lit(0.0)
        for k, v in leaves.items():
            step = F.when(leaf == k, F.lit(float(v))).otherwise(step)
        margin = margin + step
    return margin


def prepared(t: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    return lexical(t.withColumn("host", host).withColumn("path", path))


def training_rows(labels: DataFrame, suffixes: DataFrame, rate: float) -> DataFrame:
    """Bins, y and balanced weights of the sample of labelled URLs, equal rows summed; labels have a row a URL."""
    train = prepared(labels.orderBy(F.xxhash64("url"), "url").limit(TRAIN_ROWS))
    rows = with_suffix(train, suffixes, rate).select("y", *(c.alias(k) for k, c in binned().items()))
    rows = rows.groupBy("y", *binned()).agg(F.count("*").cast("double").alias("n"))
    total = rows.groupBy("y").agg(F.sum("n").alias("class_n"))
    return rows.join(F.broadcast(total), "y").withColumn("w", F.col("n") / F.col("class_n")).drop("class_n")


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    labels = scratch.keep(labels.where("url is not null and y in (0, 1)").groupBy("url").agg(F.max("y").alias("y")))
    n, n_block = labels.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    t = prepared(pages.select("page_id", "url"))
    score = F.lit(0.0)
    if 0 < n_block < n:
        suffixes, rate = scratch.keep(suffix_counts(labels)), n_block / n
        rows = scratch.keep(training_rows(labels, suffixes, rate))
        n_rows, n_kinds = rows.agg(F.sum("n"), F.count_distinct("y")).first()
        if n_kinds == 2:
            # weights of a mean of 1, half of them to each kind
            margin = boost(rows.withColumn("w", F.col("w") * (n_rows / 2)))
            t = with_suffix(t, suffixes, rate).withColumns(binned())
            score = 1 / (1 + F.exp(-margin))
    t = t.withColumns({"rule": rule_for("host", "path", rules), "score": F.round(score, 6)})
    by_rule = F.create_map(*(F.lit(x) for r in rules for x in r))
    by_model = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return t.select("page_id", "host", "path", "rule", F.coalesce(by_rule[F.col("rule")], by_model).alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, labelled(pages))
