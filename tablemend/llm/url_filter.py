"""URL verdicts: rules by host and path, and a logistic regression for all other URLs.

The model reads the character n-grams (3 to 5) of host and path, hashed into 2^16 cells.
It is trained from a small labelled table of URLs (``url``, ``blocked``), at most
``max_rows`` of them, drawn by a hash of the URL; that bound holds at any size of the
table to be judged.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
path: from there up to ``?``, ``#`` or the end; both are empty for a null or a URL without
``://``.  A rule fits its host and all subdomains if the path starts with the rule's; the
longest rule wins, of equally long ones the first.  Without labelled rows, or with labels
of one kind, the model gives the share of blocked rows (0 without any).  Empty hosts and
paths are judged by the model's intercept.  Repeated rows get the same verdict, a score equal to
the threshold blocks, an empty table gives no rows.  Other columns may have any name that does not
begin with two underscores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.llm.common import ascii_lower
from tablemend.llm.textvec import chunks, mix, powers

CELLS = 1 << 16
SIZES = (3, 4, 5)
MAX_ROWS = 20_000


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def winning_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """A struct (name, verdict) of the longest rule that fits, or null.  The rules are a short list of the user."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def ngram_cells(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, row, cell) of chunks of texts: the cells of all n-grams, in row order."""
    step = 0x9E3779B97F4A7C17
    for lo, hi, data, offs in chunks(texts):
        rows, cells = [], []
        row = np.repeat(np.arange(hi - lo), np.diff(offs))
        for n in SIZES:
            if len(data) < n:
                continue
            code = np.zeros(len(data) - n + 1, np.uint64)
            for k, p in enumerate(powers(step, n)):
                code += (data[k:len(data) - n + 1 + k].astype(np.uint64) + np.uint64(n)) * p
            inside = row[: len(code)] == row[n - 1:]
            rows.append(row[: len(code)][inside])
            cells.append((mix(code[inside]) % np.uint64(CELLS)).astype(np.int64))
        if not rows:
            yield hi - lo, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        r, c = np.concatenate(rows), np.concatenate(cells)
        order = np.argsort(r, kind="stable")
        yield hi - lo, r[order], c[order]


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    intercept: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The probability of being blocked."""
        out = []
        for n, row, cell in ngram_cells(texts):
            total = np.bincount(row, self.weights[cell], minlength=n)
            out.append(self.intercept + total / np.sqrt(np.maximum(1, np.bincount(row, minlength=n))))
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: pa.Array, blocked: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> UrlModel:
    """Full-batch gradient descent with Adam's step sizes."""
    n, base = len(blocked), float(np.mean(blocked)) if len(blocked) else 0.0
    start = float(np.log((base + 1e-6) / (1 - base + 1e-6)))
    if base in (0.0, 1.0):
        return UrlModel(np.zeros(CELLS), start)
    rows, cells, at = [], [], 0
    for size, row, cell in ngram_cells(texts):
        rows.append(row + at)
        cells.append(cell)
        at += size
    row, cell = np.concatenate(rows), np.concatenate(cells)
    value = (1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=n))))
    w, b, m, v = np.zeros(CELLS), start, np.zeros(CELLS + 1), np.zeros(CELLS + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(row, w[cell], minlength=n) * value
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - blocked) / n
        g = np.append(np.bincount(cell, (error * value)[row], minlength=CELLS) + ridge * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return UrlModel(w, float(b))


def train(labelled: DataFrame, max_rows: int = MAX_ROWS) -> UrlModel:
    """The model of at most ``max_rows`` rows (url, blocked) that a hash of the URL draws."""
    url = F.coalesce(labelled["url"], F.lit(""))
    known = labelled.filter(labelled["blocked"].isNotNull())
    drawn = known.select((F.concat(host_of(url), path_of(url))).alias("text"), known["blocked"].cast("int").alias("y"),
                         F.xxhash64(url).alias("h"))
    sample = drawn.orderBy("h", "text", "y").limit(max_rows).toArrow()
    return fit(sample["text"].combine_chunks(), sample["y"].to_numpy().astype(float))


def judge(pages: DataFrame, rules: Sequence[UrlRule], model: UrlModel, threshold: float = 0.5) -> DataFrame:
    """``pages`` with __host, __path, __rule (null if none fits), __score (the model's) and __verdict."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts), pa.float64())

    host, path = host_of(pages["url"]), path_of(pages["url"])
    rule = winning_rule(host, path, rules)
    scored = score(F.concat(host, path))
    by_model = F.when(scored >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return pages.withColumns({
        "__host": host, "__path": path, "__rule": rule["name"], "__score": scored,
        "__verdict": F.coalesce(rule["verdict"], by_model),
    })
