"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Features are SQL expressions. The trees are fitted on the driver over a bounded sample of labelled
URLs and then written out as SQL CASE expressions, so scoring is one projection in the JVM, without
Python. The rate of bad URLs of each host suffix is counted over all labelled URLs; a few rates are
written into the projection, more are joined as a table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Default parameters: different labelled URLs that the trees are fitted on, trees, their depth, bins a feature, shrinkage.
MAX_TRAIN, TREES, DEPTH, BINS, RATE = 20_000, 24, 3, 16, 0.3
#: A suffix's rate counts as many URLs of the overall rate besides its own; for a training row it leaves out the row's fold.
SMOOTH, FOLDS = 10, 5
#: More rules, or suffixes, than this are joined, not written into an expression.
MAX_INLINE_RULES, MAX_INLINE_SUFFIXES = 200, 100


# ---------------------------------------------------------------- parts of a URL


def host_of(url: str) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; '' for null or without ://."""
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: str) -> Column:
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise(F.lit(""))


# ---------------------------------------------------------------- rules


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host.lower(), slash + path)


#: The rules of the registered query.
DEFAULT_RULES = [parse_rule(*r) for r in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    at_host = (host == rule.host) | host.endswith("." + rule.host)
    return at_host & path.startswith(rule.path)


def _inline(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Longest first, so the first that fits wins; of equally long ones a block."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block", r.name)):
        hit = _fits(r, F.col("host"), F.col("path"))
        name, verdict = F.when(hit, F.lit(r.name)).otherwise(name), F.when(hit, F.lit(r.verdict)).otherwise(verdict)
    return df.select("*", name.alias("rule"), verdict.alias("rule_verdict"))


def _joined(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """For long lists: equi-join on the distinct (host suffix, path) pairs, then the longest rule for each pair."""
    spark = df.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.name, r.verdict) for r in rules], "r_host string, r_path string, rule string, rule_verdict string").distinct()
    pairs = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = pairs.select("host", "path", F.explode(suffixes).alias("r_host")).join(table, "r_host").where(F.col("path").startswith(F.col("r_path")))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("rule_verdict") == "block").alias("b"), "rule", "rule_verdict")).alias("best"))
    return df.join(best, ["host", "path"], "left").withColumns({"rule": F.col("best.rule"), "rule_verdict": F.col("best.rule_verdict")}).drop("best")


# ---------------------------------------------------------------- features


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text).cast("double")
    letters = F.array_distinct(F.split(text, ""))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(letters, F.lit(0.0), lambda acc, c: acc - F.when(c == "", F.lit(0.0)).otherwise(share(c) * F.log2(share(c))))).otherwise(0.0)


def suffix_of(host: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host, ".", -2)


def features(url: Column, host: Column, path: Column, suffix_rate: Column) -> dict[str, Column]:
    n = F.length(url).cast("double")
    digits = n - F.length(F.regexp_replace(url, "[0-9]", ""))
    query = F.when(F.instr(url, "?") > 0, F.substring_index(F.expr("substring(url, instr(url, '?') + 1)"), "#", 1)).otherwise("")
    d = lambda c: c.cast("double")
    return {
        "url_length": n,
        "host_length": d(F.length(host)),
        "path_length": d(F.length(path)),
        "depth": d(_count(path, "/")),
        "labels": d(_count(host, ".")),
        "hyphens": d(_count(host, "-")),
        "digit_ratio": F.when(n > 0, digits / n).otherwise(0.0),
        "entropy": _entropy(url),
        "host_entropy": _entropy(host),
        "parameters": F.when(query != "", d(_count(query, "&")) + 1).otherwise(0.0),
        "fragment": d(F.instr(url, "#") > 0),
        "secure": d(F.lower(F.substring(url, 1, 8)) == "https://"),
        "suffix_rate": suffix_rate,
    }


# ---------------------------------------------------------------- trees


@dataclass
class Model:
    """bias, and trees as nested (feature, threshold, left if <=, right) with numbers as leaves; suffix -> smoothed rate.

    Where there are more than MAX_INLINE_SUFFIXES suffixes, all of them are in rates (suffix,
    suffix_rate) instead.
    """

    bias: float
    trees: list
    suffixes: dict[str, float]
    prior: float
    rates: DataFrame | None = field(default=None, compare=False)

    def margin(self, columns: dict[str, Column]) -> Column:
        def sql(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            f, t, a, b = node
            return F.when(columns[f] <= t, sql(a)).otherwise(sql(b))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + sql(tree)
        return total

    def suffix_rate(self, host: Column) -> Column:
        if not self.suffixes:
            return F.lit(self.prior)
        rates = F.create_map(*[F.lit(x) for pair in sorted(self.suffixes.items()) for x in pair])
        return F.coalesce(F.element_at(rates, suffix_of(host)), F.lit(self.prior))

    def with_rate(self, df: DataFrame) -> DataFrame:
        """df with suffix_rate: that of its host's suffix, the prior where no label tells."""
        if self.rates is None:
            return df.withColumn("suffix_rate", self.suffix_rate(F.col("host")))
        return df.withColumn("suffix", suffix_of(F.col("host"))).join(self.rates, "suffix", "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(self.prior))).drop("suffix")


def boost(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = 5.0, least: int = 20, weight: np.ndarray | None = None) -> tuple[float, list]:
    """Newton boosting of the logistic loss over quantile bins; a row counts weight times."""
    weight = np.ones(len(y)) if weight is None else weight
    p = ((y * weight).sum() + 1) / (weight.sum() + 2)
    bias = float(np.log(p / (1 - p)))

    def quantiles(v: np.ndarray) -> np.ndarray:
        order = np.argsort(v, kind="stable")
        total = np.cumsum(weight[order])
        return np.unique(v[order][np.searchsorted(total, np.arange(1, bins) / bins * total[-1])])

    edges = [quantiles(x[:, j]) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    margin = np.full(len(y), bias)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if level:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                left_g = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                left_h = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                left_n = np.cumsum(np.bincount(b, weight[rows], len(e) + 1))[:-1]
                gain = left_g**2 / (left_h + ridge) + (sum_g - left_g) ** 2 / (sum_h - left_h + ridge) - sum_g**2 / (sum_h + ridge)
                gain[(left_n < least) | (weight[rows].sum() - left_n < least)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (j, k))
        if best[1] is None:
            value = float(-rate * sum_g / (sum_h + ridge))
            margin[rows] += value
            return value
        j, k = best[1]
        go = binned[rows, j] <= k
        return (names[j], float(edges[j][k]), grow(rows[go], g, h, level - 1), grow(rows[~go], g, h, level - 1))

    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        out.append(grow(np.arange(len(y)), (p - y) * weight, p * (1 - p) * weight, depth))
    return bias, out


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", max_rows: int = MAX_TRAIN) -> Model:
    """Suffix rates over all labelled URLs (label 1: to be blocked), trees over at most max_rows different ones.

    The different (URL, label) of smallest content hash are taken, so the sample is the same each
    time; one that occurs often counts as often. In training, a row's suffix rate is that of the
    URLs in other folds, so it doesn't tell the row's own label.
    """
    src = labelled.select(F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.col(label_col).cast("double").alias("label")).where("label is not null")
    urls = table(src.groupBy("url", "label").agg(F.count("*").alias("w")).withColumns({"host": host_of("url"), "path": path_of("url")}).withColumns({"suffix": suffix_of(F.col("host")), "fold": F.pmod(F.xxhash64("url"), F.lit(FOLDS))}), "urls")
    folds = table(urls.groupBy("suffix", "fold").agg(F.sum("w").alias("n_fold"), F.sum(F.col("w") * F.col("label")).alias("bad_fold")), "url-suffixes")
    n, bad = folds.agg(F.sum("n_fold"), F.sum("bad_fold")).first()
    if not n:
        drop(urls, folds)
        return Model(-20.0, [], {}, 0.0)
    prior = float((bad + 1) / (n + 2))
    totals = folds.groupBy("suffix").agg(F.sum("n_fold").alias("n"), F.sum("bad_fold").alias("bad"))
    rate = lambda bad, n: (bad + SMOOTH * prior) / (n + SMOOTH)
    rates = table(totals.select("suffix", rate(F.col("bad"), F.col("n")).alias("suffix_rate")), "url-rates")
    few = rates.limit(MAX_INLINE_SUFFIXES + 1).collect()

    sample = urls.orderBy(F.xxhash64("url", "label"), "url", "label").limit(max_rows)
    sample = sample.join(totals, "suffix").join(folds, ["suffix", "fold"])
    cols = features(F.col("url"), F.col("host"), F.col("path"), rate(F.col("bad") - F.col("bad_fold"), F.col("n") - F.col("n_fold")))
    rows = sample.select(F.xxhash64("url", "label").alias("at"), "url", "label", "w", *[c.alias(f"f_{k}") for k, c in cols.items()]).orderBy("at", "url", "label").drop("at", "url").collect()
    names = list(cols)
    y, w = np.array([r["label"] for r in rows]), np.array([r["w"] for r in rows], float)
    x = np.array([[r[f"f_{k}"] for k in names] for r in rows], float)
    bias, trees = boost(x, y, names, weight=w)
    drop(urls, folds)
    if len(few) > MAX_INLINE_SUFFIXES:
        return Model(bias, trees, {}, prior, rates)
    drop(rates)
    return Model(bias, trees, {r["suffix"]: r["suffix_rate"] for r in few}, prior)


def judge(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] = DEFAULT_RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score: the longest fitting rule's verdict, else the trees'.

    A rule fits its host and all subdomains when the path starts with the rule's. score is the
    trees' probability that the URL is to be blocked (block from threshold on), given for every
    row. Null URLs, and those without ://, have an empty host and path and are scored as they are.
    Repeated rows stay repeated, other columns are ignored, an empty table gives no rows.
    """
    df = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    df = df.withColumns({"host": host_of("url"), "path": path_of("url")})
    df = _inline(df, rules) if len(rules) <= MAX_INLINE_RULES else _joined(df, rules)
    df = model.with_rate(df)
    cols = features(F.col("url"), F.col("host"), F.col("path"), F.col("suffix_rate"))
    df = df.select("page_id", "host", "path", "rule", "rule_verdict", *[c.alias(f"f_{k}") for k, c in cols.items()])
    score = 1 / (1 + F.exp(-model.margin({k: F.col(f"f_{k}") for k in cols})))
    df = df.select("page_id", "host", "path", "rule", "rule_verdict", score.alias("score"))
    return df.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def label_by_rules(pages: DataFrame, url_col: str = "url", rules: list[Rule] = DEFAULT_RULES) -> DataFrame:
    """(url, label) of the pages whose URL a rule judges: 1 where it blocks. What rules say by hand the trees carry to URLs that no rule knows."""
    df = pages.select(F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    df = df.withColumns({"host": host_of("url"), "path": path_of("url")})
    df = _inline(df, rules) if len(rules) <= MAX_INLINE_RULES else _joined(df, rules)
    return df.where("rule is not null").select("url", (F.col("rule_verdict") == "block").cast("int").alias("label"))
