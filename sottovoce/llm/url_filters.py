"""URL verdicts: prefix rules for hosts and paths first, and a classifier for the rest.

The classifier is a logistic regression on hashed character n-grams of host and path, trained by full-batch
gradient descent on a small labelled URL table (at most ``max_labelled`` rows, by order of their hashes).
Training is deterministic. The weights, whose number is fixed, go to the tasks with the function.

Edge cases: a null url or one without ``://`` has an empty host and path and is judged by the classifier;
duplicate rows give duplicate results; columns other than the id and the url are ignored; without labelled
rows of both kinds the classifier allows everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
#: Fixed values: (host and path prefix, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: The parts of invented labelled URLs; none is taken from the judged table. 1 is to be blocked.
BAD_HOSTS = (
    "cheap-pills.shop", "best-pills.example.com", "pills-discount.biz", "free-bets.win", "casino-bets.example.com", "lucky-casino.click", "spam-farm.info", "link-farm.example.net",
    "adult-x.club", "hot-adult-x.example.net", "replica-watch.top", "luxury-replica.store", "quick-loans.example.com", "payday-loans-now.biz", "crypto-doubler.xyz", "win-prize.click",
)
GOOD_HOSTS = (
    "daily-journal.net", "cityscience.edu", "gardening.example.com", "weather-report.com", "history.example.net", "riverside-library.net", "cooking-notes.example.com", "open-museum.example.net",
    "mountain-guide.info", "local-news.example.com", "mathclub.edu", "bird-atlas.net", "village-council.example.net", "oldmaps.example.com", "trainspotters.net", "poetry-review.info",
)
BAD_PATHS = ("buy/now", "win/free?id=3", "offer/cheap-deal", "en/88", "bonus/claim.html", "xxx/gallery/2")
GOOD_PATHS = ("article/1", "2021/05/notes?id=3", "about/history", "en/88", "archive/letters.html", "wiki/river")
LABELLED = tuple((f"https://{sub}{h}/{p}", y) for hosts, paths, y in ((BAD_HOSTS, BAD_PATHS, 1), (GOOD_HOSTS, GOOD_PATHS, 0)) for i, h in enumerate(hosts) for k, p in enumerate(paths) for sub in (("", "www.", "m.")[(i + k) % 3],))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for prefix, says in sorted(rules, key=lambda r: len(r[0])):
        domain, _, rest = prefix.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, prefix).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str) -> np.ndarray:
    """Buckets of the distinct character n-grams; those of the host and the path do not mix."""
    found = set()
    for tag, text in ((b"h", f"^{host}$".encode()), (b"p", f"^{path}$".encode())):
        for size in SIZES:
            found.update(tag + text[i : i + size] for i in range(len(text) - size + 1))
    return np.fromiter((crc32(g) % BUCKETS for g in sorted(found)), dtype=np.int64, count=len(found))


def train(labelled: list[tuple[str, str, int]], rounds: int = 400, rate: float = 8.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from (host, path, label)."""
    y = np.array([label for *_, label in labelled], dtype=float)
    weights, bias = np.zeros(BUCKETS), 0.0
    if not len(y) or y.min() == y.max():
        return weights, -1.0
    parts = [features(h, p) for h, p, _ in labelled]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    column, value = np.concatenate(parts), 1 / np.sqrt(np.maximum([len(p) for p in parts], 1))[row]
    for _ in range(rounds):
        z = np.bincount(row, weights[column] * value, minlength=len(y)) + bias
        error = 1 / (1 + np.exp(-z)) - y
        weights = weights * (1 - rate * decay) - rate / len(y) * np.bincount(column, error[row] * value, minlength=BUCKETS)
        bias -= rate / len(y) * error.sum()
    return weights, bias


def fit(labelled: DataFrame, max_labelled: int = 20_000) -> tuple[np.ndarray, float]:
    """Train on (url, label); the bound keeps what reaches the driver small."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.select(host.alias("h"), path.alias("p"), "label").orderBy(F.xxhash64("h", "p"), "h", "p", "label").limit(max_labelled).collect()
    return train([tuple(r) for r in rows])


def judge(pages: DataFrame, model: tuple[np.ndarray, float], rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score): score is the classifier's probability of a block, given for every row."""
    weights, bias = model
    broadcast = pages.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = broadcast.value
        for batch in batches:
            out = []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                f = features(host, path)
                out.append(1 / (1 + np.exp(-(float(w[f].sum()) / np.sqrt(max(len(f), 1)) + bias))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(out, 6), pa.float64())], [*batch.schema.names, "score"])

    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col).cast("long").alias(id_col), host.alias("host"), path.alias("path"))
    scored = split.mapInArrow(score, f"{id_col} long, host string, path string, score double")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return scored.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"), "score")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(spark.createDataFrame(list(LABELLED), "url string, label int"))
    return judge(table(spark, sf_dir, "pages"), model)


QUERIES = {"op4_url_filters": op4_url_filters}
