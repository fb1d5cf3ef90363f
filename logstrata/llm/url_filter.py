"""URL filter: host and path rules first, then a logistic regression on hashed character n-grams.

The model learns from a small labelled table. Its inputs are the 3- to 5-grams
of the host and of the path, each with end marks and hashed into ``buckets``
places (crc32), scaled to length 1. With few rows and many places, the weights
are a combination of the rows, so training runs on the Gram matrix.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_url(url: str) -> tuple[str, str]:
    """host_of and path_of of one URL."""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    intercept: float
    sizes: tuple[int, ...]

    def grams(self, host: str, path: str) -> np.ndarray:
        return _grams(host, path, self.sizes, len(self.weights))

    def score(self, host: str, path: str) -> float:
        """The chance that the URL is to be blocked."""
        at = self.grams(host, path)
        x = self.intercept + (self.weights[at].sum() / np.sqrt(at.size) if at.size else 0.0)
        return float(1 / (1 + np.exp(-x)))


def _grams(host: str, path: str, sizes: tuple[int, ...], buckets: int) -> np.ndarray:
    found = set()
    for kind, s in (("h", host), ("p", path)):
        if s:
            raw = f"^{s}$".encode("utf-8", "replace")
            start = zlib.crc32(kind.encode())
            found.update(zlib.crc32(raw[i : i + n], start) % buckets for n in sizes for i in range(len(raw) - n + 1))
    return np.fromiter(sorted(found), np.int64, len(found))


def train(block: list[str], allow: list[str], *, sizes: tuple[int, ...] = (3, 4, 5), buckets: int = 1 << 16, prior: float = 0.3, l2: float = 5e-6, rounds: int = 12_000, rate: float = 8.0) -> UrlModel:
    """Full-batch descent with a ridge penalty and even odds; rows of both labels weigh the same in sum.

    Then the intercept gives the odds of ``prior``, a share of bad URLs in a crawl: a URL of unseen
    n-grams gets that score.
    """
    rows = [_grams(*split_url(u), sizes, buckets) for u in [*block, *allow]]
    y = np.array([1.0] * len(block) + [0.0] * len(allow))
    weight = np.where(y == 1, 0.5 / max(1, len(block)), 0.5 / max(1, len(allow)))
    used = np.unique(np.concatenate([np.empty(0, np.int64), *rows]))
    x = np.zeros((len(rows), used.size))
    for r, at in zip(x, rows, strict=True):
        r[np.searchsorted(used, at)] = 1 / np.sqrt(max(1, at.size))
    gram, alpha = x @ x.T, np.zeros(len(rows))
    for _ in range(rounds if len(rows) else 0):
        slack = (y - 1 / (1 + np.exp(-(gram @ alpha)))) * weight
        alpha += rate * (slack - l2 * alpha)
    weights = np.zeros(buckets)
    weights[used] = x.T @ alpha
    return UrlModel(weights, float(np.log(prior / (1 - prior))), sizes)


Rule = tuple[str, str, str]  # verdict, host, path


def match(rules: dict[str, list[tuple[str, str]]], host: str, path: str) -> tuple[str, str] | None:
    """The longest rule whose host is this one or above it and whose path starts this one; (rule, verdict)."""
    best: tuple[str, str] | None = None
    suffix = host
    while True:
        for start, verdict in rules.get(suffix, ()):
            if path.startswith(start) and (best is None or len(suffix + start) > len(best[0])):
                best = (suffix + start, verdict)
        _, dot, suffix = suffix.partition(".")
        if not dot:
            return best


def filter_urls(pages: DataFrame, rules: list[Rule], model: UrlModel, *, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (of the model, also where a rule decides).

    Columns of these names are replaced. A null URL or one without ``://`` has an empty host and
    path, fits no rule, and gets the model's verdict on no n-grams. Of two equal rules the first
    holds. One pass without a shuffle; the model and the rules are parameters, not corpus data.
    """
    added = ["host", "path", "rule", "verdict", "score"]
    kept = pages.drop(*[c for c in added if c != url])
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        by_host.setdefault(host, []).append((path, verdict))
    kept = kept.withColumns({"_host": host_of(F.col(url)), "_path": path_of(F.col(url))})
    schema = T.StructType([*kept.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_host", "_path"))
            found, verdicts, scores = [], [], []
            for h, p in zip(hosts, paths, strict=True):
                rule = match(by_host, h, p)
                s = model.score(h, p)
                found.append(rule and rule[0])
                verdicts.append(rule[1] if rule else "block" if s >= threshold else "allow")
                scores.append(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], schema.fieldNames())

    judged = kept.mapInArrow(run, schema)
    return judged.withColumnsRenamed({"_host": "host", "_path": "path"})
