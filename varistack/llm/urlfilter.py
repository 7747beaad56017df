"""URL filter: prefix rules first, then a logistic model on hashed character n-grams.

Host and path are hashed into separate spaces of n-grams. The model is fitted to a small labelled
URL table; its verdict holds where no rule fits.
"""

from __future__ import annotations

import csv
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varistack.llm.common import map_text, table

BUCKETS = 1 << 16
NGRAMS = (3, 4, 5)
L2 = 0.05
#: Bound of the labelled URL table that the model is fitted to (rows of smallest hash first).
MAX_LABELLED = 4000
BLOCK_AT = 0.5
#: Weight of all blocked rows in the fit; under a half, as a URL that says nothing is to be allowed.
BLOCK_SHARE = 0.3


class UrlRule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)
#: A small labelled table: hosts that decide whatever the path, and hosts on which the path decides.
PREFIXES = ("", "www.", "m.", "blog.")
LABELS = Path(__file__).with_name("url_labels.csv")


def labelled_urls(path: str | Path = LABELS) -> list[tuple[str, int]]:
    """``(url, blocked)`` rows of a small CSV file with these columns, read on the driver.

    Each stands with every one of ``PREFIXES``, so that these say nothing.
    """
    with open(path, newline="") as file:
        rows = [(row["url"], int(row["blocked"])) for row in csv.DictReader(file)]
    return [(url.replace("://", f"://{prefix}", 1), blocked) for url, blocked in rows for prefix in PREFIXES]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path from there
    up to ``?``, ``#`` or the end. Both are empty for a null URL or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits, or nulls. A rule fits its host and all its subdomains."""
    name = action = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the longest is tested first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, action = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.action).otherwise(action)
    return name, action


def _grams(host: str, path: str) -> np.ndarray:
    from zlib import crc32

    out = set()
    for space, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        out.update(crc32(f"{space}{part[i : i + n]}".encode("utf-8", "surrogatepass")) % BUCKETS for n in NGRAMS for i in range(len(part) - n + 1))
    return np.fromiter(sorted(out), np.int64, len(out))


def train(labelled: list[tuple[str, str, int]], l2: float = L2, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias from ``(host, path, blocked)`` rows, in a fixed order; zeros without rows."""
    labelled = sorted(labelled)
    grams = [_grams(h, p) for h, p, _ in labelled]
    y = np.array([b for *_, b in labelled], np.float64)
    w, bias, velocity = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS + 1)
    if not len(y):
        return w, bias
    row, col = np.repeat(np.arange(len(y)), [len(g) for g in grams]), np.concatenate(grams)
    scale = 1 / np.sqrt(np.bincount(row, minlength=len(y)))
    weight = np.where(y == 1, BLOCK_SHARE / max(1, y.sum()), (1 - BLOCK_SHARE) / max(1, len(y) - y.sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(bias + scale * np.bincount(row, w[col], len(y)))))
        error = weight * (p - y)
        grad = np.append(np.bincount(col, (error * scale)[row], BUCKETS) + l2 / len(y) * w, error.sum())
        velocity = 0.9 * velocity + grad
        w, bias = w - 2 * velocity[:-1], bias - 2 * velocity[-1]
    return w, bias


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[UrlRule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(id_col, host, path, rule, score, verdict)`` per row.

    ``labelled`` has ``url`` and ``blocked`` (0 or 1); at most ``max_labelled`` distinct rows of it are
    used. score is the model's probability of a block for every URL; verdict is the rule's action, else
    the model's. A null URL has an empty host and path. Null and repeated ids are kept.
    """
    known_host, known_path = host_and_path(F.col("url"))
    known = labelled.where("url is not null and blocked is not null").select(known_host.alias("host"), known_path.alias("path"), F.col("blocked").cast("int").alias("blocked")).distinct()
    rows = known.orderBy(F.xxhash64("host", "path"), "host", "path", "blocked").limit(max_labelled).collect()  # of bounded size
    weights, bias = train([tuple(r) for r in rows])
    shared = pages.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    kind = pages.schema[id_col].dataType.simpleString()
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, out = shared.value, []
        for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            grams = _grams(h, p)
            z = bias + float(w[grams].astype(np.float64).sum()) / np.sqrt(max(1, len(grams)))
            out.append(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))
        return batch.append_column("score", pa.array(np.array(out, np.float64)))

    scored = map_text(parsed, run, f"id {kind}, host string, path string, score double", "path")
    name, action = matched_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("score") >= BLOCK_AT, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", name.alias("rule"), "score", verdict.alias("verdict"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, spark.createDataFrame(labelled_urls(), "url string, blocked int")).select("page_id", "host", "path", "rule", "verdict", "score")
