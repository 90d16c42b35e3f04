"""URL filters: rules first, gradient-boosted trees on lexical features for what no rule covers.

Host, path and rule are column expressions. The trees are trained on the driver from at most
``sample_rows`` labelled URLs (here: those that a rule labels) with the logistic loss, depth 3, on
quantile bins; both verdicts weigh the same. Suffix statistics (smoothed block rates of the last one and two host labels) are features;
in training a URL's are taken from the other folds only, which are dealt by domain (the last two host labels), so that no domain's own label
speaks for it. Scores are scaled by how well they tell the verdicts of domains that were held out: where the labels carry over
to no other domain, every probability is 1/2. What no rule covers is blocked from a probability of BLOCK_AT on. Scoring runs over Arrow batches of URLs and never reads the pages.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAMPLE_ROWS = 20_000
#: URLs without a rule are blocked on clear evidence only.
BLOCK_AT = 0.8
#: Held-out scores that separate perfectly would be scaled without end.
MOST_SCALE = 3.0
FOLDS = 5
FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "longest_label", "hyphens", "digit_ratio",
    "host_digit_ratio", "entropy", "host_entropy", "parameters", "query_length", "fragment", "secure", "suffix_rate", "suffix2_rate", "suffix_share",
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null. A rule ``host/path`` fits the host and its subdomains."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _split(url: str | None) -> tuple[str, str, str, bool]:
    if not url or "://" not in url:
        return "", "", "", False
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)(\?[^#]*)?", rest)
    return m[1].lower(), m[2], (m[3] or "")[1:], "#" in rest


def _entropy(s: str) -> float:
    if not s:
        return 0.0
    p = np.array(list(Counter(s).values())) / len(s)
    return float(-(p * np.log2(p)).sum())


def _suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


@dataclass
class Trees:
    """Boosted trees and the statistics that their features need."""

    prior: float = 0.0
    rate: float = 0.5
    scale: float = 1.0
    suffix: dict[str, tuple[float, float]] = field(default_factory=dict)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, threshold, leaf values

    def features(self, urls: list[str | None]) -> np.ndarray:
        rows = []
        for url in urls:
            host, path, query, fragment = _split(url)
            text, labels = url or "", host.split(".")
            s1, s2 = _suffixes(host)
            r1, r2 = self.suffix.get(s1, (self.rate, 0.0)), self.suffix.get(f".{s2}", (self.rate, 0.0))
            rows.append((
                len(text), len(host), len(path), sum(1 for x in path.split("/") if x), len(labels), max(map(len, labels)), host.count("-"),
                sum(c.isdigit() for c in text) / max(1, len(text)), sum(c.isdigit() for c in host) / max(1, len(host)),
                _entropy(text), _entropy(host), sum(1 for x in query.split("&") if x), len(query), fragment, text[:6].lower() == "https:", r1[0], r2[0], r1[1],
            ))
        return np.array(rows, dtype=np.float64).reshape(len(rows), len(FEATURES))

    def probability(self, urls: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.scale * self.score(urls)))

    def score(self, urls: list[str | None]) -> np.ndarray:
        x = self.features(urls)
        score = np.full(len(x), self.prior)
        for feature, threshold, leaf in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
            score += leaf[at - len(feature)]
        return score


def folds_of(urls: list[str | None]) -> np.ndarray:
    """The folds of URLs: whole hosts in the order of a hash, dealt in turn, so no host is on both sides."""
    host = [_split(u)[0] for u in urls]
    order = sorted(set(host), key=lambda d: (zlib.crc32(d.encode()), d))
    fold = {d: k % FOLDS for k, d in enumerate(order)}
    return np.array([fold[d] for d in host], np.int64)


def _suffix_rates(urls: list[str | None], block: list[bool], rate: float) -> dict[str, tuple[float, float]]:
    """Per suffix the block rate, smoothed towards the overall rate, and its share of the URLs."""
    n, hit = Counter(), Counter()
    for url, b in zip(urls, block, strict=True):
        s1, s2 = _suffixes(_split(url)[0])
        n.update((s1, f".{s2}"))
        hit.update({s1: int(b), f".{s2}": int(b)})
    return {s: ((hit[s] + 5 * rate) / (c + 5), c / len(urls)) for s, c in n.items()}


def held_out_scores(urls: list[str | None], block: list[bool], **how) -> np.ndarray:
    """The score of every URL by trees that were fitted without its fold of hosts; 0 where nothing else can be fitted on."""
    fold, out = folds_of(urls), np.zeros(len(urls))
    for f in np.unique(fold):
        other, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len({block[k] for k in other}) == 2:
            out[own] = _boost([urls[k] for k in other], [block[k] for k in other], **how).score([urls[k] for k in own])
    return out


def fit(urls: list[str | None], block: list[bool], **how) -> Trees:
    """Boosted trees, their scores scaled to the likeliest verdicts of held-out hosts: 0 if these are told at chance."""
    model, y = _boost(urls, block, **how), np.array(block, dtype=np.float64)
    if not model.trees:
        return model
    score, a = held_out_scores(urls, block, **how), 0.0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(30):  # logistic regression on the score alone
        p = 1 / (1 + np.exp(-a * score))
        a += float((weight * (y - p) * score).sum() / ((weight * p * (1 - p) * score**2).sum() + 1))
        a = min(max(a, 0.0), MOST_SCALE)
    model.scale = a
    return model


def _boost(urls: list[str | None], block: list[bool], n_trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32) -> Trees:
    """Newton boosting of the logistic loss. Suffix rates are smoothed towards 1/2, and out of fold in training."""
    y = np.array(block, dtype=np.float64)
    model = Trees(rate=0.5)
    if not len(y) or y.all() or not y.any():  # nothing to tell apart: nothing is blocked
        model.prior = -5.0
        return model
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    fold = folds_of(urls)
    x = np.zeros((len(y), len(FEATURES)))
    for f in np.unique(fold):
        other = np.flatnonzero(fold != f)
        seen = replace(model, suffix=_suffix_rates([urls[k] for k in other], [block[k] for k in other], model.rate)) if len(other) else model
        x[fold == f] = seen.features([urls[k] for k in np.flatnonzero(fold == f)])
    model.suffix = _suffix_rates(urls, block, model.rate)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    score = np.full(len(y), model.prior)
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        inner = 2**depth - 1
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = at == node
                best = 1e-6
                gt, ht = g[mine].sum(), h[mine].sum()
                for j, e in enumerate(edges):
                    if not len(e) or not mine.any():
                        continue
                    gl = np.cumsum(np.bincount(binned[mine, j], g[mine], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[mine, j], h[mine], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[node], threshold[node] = gain[k], j, e[k]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf_at = at - inner
        leaf = rate * np.bincount(leaf_at, g, 2**depth) / (np.bincount(leaf_at, h, 2**depth) + 1)
        score += leaf[leaf_at]
        model.trees.append((feature, threshold, leaf))
    return model


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", sample_rows: int = SAMPLE_ROWS, labelled: DataFrame | None = None) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, p_block.

    ``rules`` are (rule, verdict) pairs such as ("example.net/en/", "allow"). ``labelled`` has the URLs to learn from (url, verdict);
    without it they are those that a rule labels. Trained on at most ``sample_rows`` distinct ones (those with the smallest hash).

    Defined cases: a null URL or one without ``://`` has an empty host and path and no rule; the trees judge it; with no labelled
    URL, or labels of one verdict only, everything without a rule is allowed; a null id is carried along; repeated rows repeat;
    an empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = url_parts(F.col("url"))
    ruled = rows.select("id", "url", host.alias("host"), path.alias("path"))
    ruled = ruled.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    verdict = reduce(lambda acc, r: F.when(F.col("rule") == r[0], F.lit(r[1])).otherwise(acc), rules, F.lit(None).cast("string"))
    if labelled is None:
        labelled = ruled.filter(F.col("rule").isNotNull()).select("url", verdict.alias("verdict"))
    labelled = labelled.filter(F.col("verdict").isin("allow", "block")).select("url", "verdict").distinct()
    part = F.shiftrightunsigned(F.xxhash64("url"), 52).cast("int")
    last, room = 4095, sample_rows
    for r in sorted(labelled.groupBy(part.alias("part")).count().collect()):  # at most 4096 rows; later parts are out before the limit
        room -= r["count"]
        if room <= 0:
            last = r["part"]
            break
    sample = labelled.filter(part <= last).orderBy(part, F.xxhash64("url"), "url").limit(sample_rows).collect()
    held = spark.sparkContext.broadcast(fit([r["url"] for r in sample], [r["verdict"] == "block" for r in sample]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = held.value.probability(batch.column("url").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "host", "path", "rule")), pa.array(p, pa.float64())], names=["id", "host", "path", "rule", "p_block"])
        release_memory()

    scored = ruled.mapInArrow(score, f"id {id_type}, host string, path string, rule string, p_block double")
    by_trees = F.when(F.col("p_block") >= BLOCK_AT, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(F.col("id").alias("page_id"), "host", "path", "rule", F.coalesce(verdict, by_trees).alias("verdict"), "p_block")


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
