"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the URLs that no rule covers.

A rule is a host and a path (``example.net/en/``); it fits that host and its subdomains where the path starts with the
rule's. The longest rule wins (of equally long ones that with the longer host, then the greater text, then "block").

The trees learn from the URLs that rules cover (or from any labelled URLs given to ``train``): length, depth, digit ratio,
entropy, parameters, and statistics of the host's suffixes (its last label and its last two): how many pages stand under it, and
which share of its labelled URLs is blocked, for labelled URLs taken from the other one of two folds, so that no URL sees its own label.
Features fall into BINS fixed bins. Equal labelled rows are counted first, and every level of a tree is one Spark sum of first and second
derivatives by node, feature and bin over all labelled rows, in fixed-point numbers, so that reruns agree; the driver gets at
most 2 ** DEPTH x features x BINS rows a level. Nothing is sampled.

A null URL, and one without ``://``, has an empty host and path and is judged by the trees like any other. Repeated rows get
the same verdict. Without labelled URLs every other URL is allowed; with one class only, all get that class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import ascii_lower, materialize, skew_join, table

#: The rules of the registered query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
INLINE = 1000  # rules that are looked up within a row; more are joined
BINS, TREES, DEPTH, RATE, RIDGE, PRIOR, FIXED = 32, 12, 3, 0.4, 1.0, 20.0, 1e6
_RULE = "array<struct<size:int,host_size:int,rule:string,verdict:string>>"


def parts_of(url: Column) -> dict[str, Column]:
    """host (A-Z lower-cased), path and query of a URL; all empty without "://"."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    cut = lambda k: F.regexp_extract(url, r"://([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    return {"host": ascii_lower(cut(1)), "path": cut(2), "query": cut(3)}


def host_suffixes(host: str) -> Column:
    """The host, and what is left of it without its first labels."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def _split_rule(verdict: str, rule: str) -> tuple[str, str, str]:
    assert verdict in ("allow", "block") and "/" in rule, f"no rule: {verdict} {rule}"
    host, _, path = rule.partition("/")
    return "".join(c.lower() if c.isascii() else c for c in host), "/" + path, verdict


def _found(suffix: Column, path: Column, verdict: Column) -> Column:
    return F.struct((F.length(suffix) + F.length(path)).alias("size"), F.length(suffix).alias("host_size"), F.concat(suffix, path).alias("rule"), verdict.alias("verdict"))


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """urls (host, path and others) with the rule that fits best and its verdict, or null."""
    split = sorted({_split_rule(*r) for r in rules})
    if not split:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    if len(split) <= INLINE:
        by_host: dict[str, list] = {}
        for host, path, verdict in split:
            by_host.setdefault(host, []).append(F.struct(F.lit(path).alias("path"), F.lit(verdict).alias("verdict")))
        known = F.create_map(*[x for host, own in by_host.items() for x in (F.lit(host), F.array(*own))])
        none = F.array().cast("array<struct<path:string,verdict:string>>")
        fits = F.transform(host_suffixes("host"), lambda s: F.transform(F.filter(F.coalesce(F.try_element_at(known, s), none), lambda r: F.startswith(F.col("path"), r["path"])), lambda r: _found(s, r["path"], r["verdict"])))
        return urls.withColumn("_best", F.array_max(F.flatten(fits).cast(_RULE))).withColumns({"rule": F.col("_best.rule"), "verdict": F.col("_best.verdict")}).drop("_best")
    # rules are as many as the caller's list; equal places are looked up once, and no host is hot among different ones
    listed = urls.sparkSession.createDataFrame(split, "_suffix string, _path string, _verdict string")
    places = materialize(urls.groupBy("host", "path").agg(F.count("*").alias("n")), "url-places")
    each = places.select("host", "path", F.explode(host_suffixes("host")).alias("_suffix")).join(F.broadcast(listed), "_suffix").where(F.startswith("path", "_path"))
    best = each.groupBy("host", "path").agg(F.max(_found(F.col("_suffix"), F.col("_path"), F.col("_verdict"))).alias("_best"))
    known = materialize(places.join(best, ["host", "path"], "left").select("host", "path", "n", "_best.rule", "_best.verdict"), "ruled-places")
    return skew_join(urls, known, ["host", "path"]).drop("n")


def _bits(text: Column) -> Column:
    """Entropy of a text's characters in bits."""
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(F.length(c) > 0, share(c)))
    return F.aggregate(each, F.lit(0.0), lambda a, p: a - F.coalesce(F.when(p > 0, p * F.log2(p)), F.lit(0.0)))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def lexical() -> dict[str, tuple[Column, float, float]]:
    """Features of url, host, path and query, with the range that is cut into bins."""
    url, host, path, query = (F.col(c) for c in ("url", "host", "path", "query"))
    log = lambda c: F.log2(1 + c.cast("double"))
    last = F.regexp_extract(path, r"([^/]*)/*$", 1)
    share = lambda text, pattern: F.coalesce(_count(text, pattern) / F.when(F.length(text) > 0, F.length(text)), F.lit(0.0))
    return {
        "length": (log(F.length(url)), 0, 12),
        "host_length": (log(F.length(host)), 0, 8),
        "host_labels": (_count(host, r"[^.]+"), 0, 8),
        "hyphens": (_count(host, "-"), 0, 8),
        "depth": (_count(path, "[^/]+"), 0, 16),
        "last_length": (log(F.length(last)), 0, 8),
        "extension": (log(F.length(F.regexp_extract(last, r"\.([^.]*)$", 1))), 0, 8),
        "digit_ratio": (share(url, "[0-9]"), 0, 1),
        "host_digit_ratio": (share(host, "[0-9]"), 0, 1),
        "entropy": (F.coalesce(F.when(F.length(url) > 0, _bits(url)), F.lit(0.0)), 0, 8),
        "host_entropy": (F.coalesce(F.when(F.length(host) > 0, _bits(host)), F.lit(0.0)), 0, 8),
        "params": (_count(query, "[^&]+"), 0, 16),
        "query_length": (log(F.length(query)), 0, 10),
    }


_SUFFIX_FEATURES = {"last_pages": (0, 40), "site_pages": (0, 40), "last_blocked": (0, 1), "site_blocked": (0, 1)}


def _binned(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(F.floor((value - low) / (high - low) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")


def featured(rows: DataFrame) -> DataFrame:
    """rows (url, host, path, query, blocked: 1, 0 or null) with x, the bins of all features. Written on the way."""
    labels = F.split("host", r"\.")
    last, site = F.element_at(labels, -1), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    own = [_binned(*f) for f in lexical().values()]
    rows = rows.withColumns({"_last": last, "_site": site, "_fold": F.crc32(F.col("url").cast("binary")) % 2, "_own": F.array(*own)})
    rows = materialize(rows, "url-features")
    sums = [F.count("*").alias("n"), *[F.sum(F.when(F.col("_fold") == k, c)).alias(f"{name}{k}") for k in (0, 1) for name, c in (("l", F.col("blocked").isNotNull().cast("long")), ("b", F.col("blocked")))]]
    sites = rows.groupBy("_last", "_site").agg(*sums)
    sites = sites.na.fill(0, ["l0", "b0", "l1", "b1"])
    sites = materialize(sites, "url-sites")
    names = ("n", "l0", "b0", "l1", "b1")
    lasts = materialize(sites.groupBy("_last").agg(F.count("*").alias("_sites"), *[F.sum(c).alias(f"t_{c}") for c in names]), "url-endings")
    sites = materialize(skew_join(sites, lasts, ["_last"], "_sites").drop("_last", "_sites"), "url-suffixes")
    total = lasts.agg(*[F.coalesce(F.sum(f"t_{c}"), F.lit(0)).alias(c) for c in names[1:]]).first()
    overall = (total.b0 + total.b1) / max(1, total.l0 + total.l1)

    def blocked(prefix: str) -> Column:
        def of(kind: str) -> Column:
            one, other = F.col(f"{prefix}{kind}0"), F.col(f"{prefix}{kind}1")
            return F.when(F.col("blocked").isNull(), one + other).when(F.col("_fold") == 0, other).otherwise(one)

        return (of("b") + PRIOR * overall) / (of("l") + PRIOR)

    values = {"last_pages": F.log2(1 + F.col("t_n")), "site_pages": F.log2(1 + F.col("n")), "last_blocked": blocked("t_"), "site_blocked": blocked("")}
    more = [_binned(values[name], *bounds) for name, bounds in _SUFFIX_FEATURES.items()]
    joined = skew_join(rows, sites, ["_site"])
    return joined.withColumn("x", F.concat("_own", F.array(*more))).drop("_own", "_last", "_site", "_fold", *names, *[f"t_{c}" for c in names])


FEATURES = 13 + len(_SUFFIX_FEATURES)


class Trees:
    """Boosted trees of one depth over bins: a row goes right where its feature's bin is above the node's."""

    def __init__(self, start: float):
        self.start, self.feature, self.bin, self.leaf = start, [], [], []

    @staticmethod
    def place(x: np.ndarray, feature: np.ndarray, bins: np.ndarray, depth: int) -> np.ndarray:
        """The place among the nodes of a level that each row comes to."""
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            node = at + (1 << level) - 1
            at = 2 * at + (x[np.arange(len(x)), feature[node]] > bins[node])
        return at

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for feature, bins, leaf in zip(self.feature, self.bin, self.leaf, strict=True):
            total += leaf[self.place(x, feature, bins, DEPTH)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _bins(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, FEATURES)


def _sums(counted: DataFrame, trees: Trees, feature: np.ndarray, bins: np.ndarray, level: int) -> np.ndarray:
    """Sums of first and second derivatives by node of the level, feature and bin."""
    held = counted.sparkSession.sparkContext.broadcast((trees, feature, bins))
    shape = (1 << level, FEATURES, BINS)

    def run(batches):
        model, feature, bins = held.value
        total = np.zeros((2, *shape), np.int64)
        for batch in batches:
            x, n, b = _bins(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            p = model.score(x)
            node = Trees.place(x, feature, bins, level)
            for k, d in enumerate((b - n * p, n * p * (1 - p))):
                np.add.at(total[k], (node[:, None], np.arange(FEATURES)[None, :], x), np.rint(d * FIXED).astype(np.int64)[:, None])
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0].ravel()[at]), pa.array(total[1].ravel()[at])], ["at", "g", "h"])

    summed = counted.select("x", "n", "b").mapInArrow(run, "at int, g long, h long").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    total = np.zeros((2, int(np.prod(shape))))
    for r in summed.collect():  # a row a node, feature and bin
        total[:, r["at"]] = r.g / FIXED, r.h / FIXED
    return total.reshape(2, *shape)


def train(labelled: DataFrame) -> Trees | float:
    """Trees fitted to rows (x, blocked); a constant where there is one class or none."""
    counted = materialize(labelled.groupBy("x").agg(F.count("*").alias("n"), F.sum("blocked").cast("long").alias("b")), "labelled-urls")
    n, b = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    if b in (0, n):
        return float(b > 0)
    trees = Trees(float(np.log(b / (n - b))))
    for _ in range(TREES):
        # a node that is not split sends all of its rows left
        feature, bins = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, BINS)
        leaf = np.zeros(1 << DEPTH)
        for level in range(DEPTH):
            g, h = _sums(counted, trees, feature, bins, level)
            left_g, left_h = g.cumsum(2), h.cumsum(2)
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            worth = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            for k in range(1 << level):
                f, cut = np.unravel_index(int(worth[k].argmax()), worth[k].shape)
                if split := bool(worth[k, f, cut] > 1e-9):
                    feature[(1 << level) - 1 + k], bins[(1 << level) - 1 + k] = f, cut
                if level == DEPTH - 1:
                    lg, lh = (left_g[k, f, cut], left_h[k, f, cut]) if split else (all_g[k, 0, 0], all_h[k, 0, 0])
                    leaf[2 * k] = RATE * lg / (lh + RIDGE)
                    leaf[2 * k + 1] = RATE * (all_g[k, 0, 0] - lg) / (all_h[k, 0, 0] - lh + RIDGE) if split else 0
        trees.feature.append(feature)
        trees.bin.append(bins)
        trees.leaf.append(leaf)
    return trees


def scores(rows: DataFrame, model: Trees | float) -> DataFrame:
    """rows (x and others) with score, 0 to 1, instead of x."""
    if isinstance(model, float):
        return rows.drop("x").withColumn("score", F.lit(model))
    held = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c != "x"]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held.value.score(_bins(batch.column(len(names)))))], [*names, "score"])

    kinds = dict(rows.dtypes)
    return rows.select(*names, "x").mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in names] + ["score double"]))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score for every row of pages (page_id, url).

    The trees learn from the URLs that rules cover, or from labelled (url, blocked) instead.
    """
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    rows = ruled(urls.withColumns(parts_of(F.col("url"))), rules)
    if labelled is None:
        rows = rows.withColumn("blocked", F.when(F.col("verdict").isNotNull(), (F.col("verdict") == "block").cast("int")))
    else:
        marked = labelled.where("url is not null").select(F.lit(None).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("blocked").cast("int").alias("blocked"))
        marked = marked.withColumns(parts_of(F.col("url"))).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
        rows = rows.withColumn("blocked", F.lit(None).cast("int")).unionByName(marked.where("blocked is not null"))
    rows = materialize(featured(rows.withColumn("given", F.lit(labelled is not None) & F.col("blocked").isNotNull())), "judged-urls")
    found = scores(rows.where("not given"), train(rows.where("blocked is not null")))
    learned = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", learned).alias("verdict"), "score")


def op13_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of the URL of every page; score is the trees' probability of "block", also where a rule decides."""
    return judge(table(spark, sf_dir, "pages"))


def url_rules(spark, sf_dir: str) -> DataFrame:
    """What SQL can say of op13_url_filter: rule and its verdict, both empty where no rule fits."""
    urls = table(spark, sf_dir, "pages").select("page_id", *[c.alias(k) for k, c in parts_of(F.col("url")).items() if k != "query"])
    return ruled(urls).select("page_id", "host", "path", *[F.coalesce(c, F.lit("")).alias(c) for c in ("rule", "verdict")])


RULES_SQL = (
    r"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), rules(verdict, rule, h, p) AS (VALUES """
    + ", ".join(f"('{v}', '{r}', '{_split_rule(v, r)[0]}', '{_split_rule(v, r)[1]}')" for v, r in RULES)
    + r""")
SELECT page_id, host, path,
  coalesce((SELECT arg_max(rule, length(rule)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), '') AS rule,
  coalesce((SELECT arg_max(verdict, length(rule)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), '') AS verdict
FROM cut
"""
)
