"""Corpus BLEU and chrF, over all rows or by a column.

Sentences give counts only, without a shuffle of n-grams; these are summed before
anything is divided.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paralex.functions.text import strip, tokens_13a, without_space

#: Fixed values of the metrics.
BLEU_ORDER, CHRF_ORDER, BETA = 4, 6, 2
DIGITS = 4


def clipped_counts(hyp: np.ndarray, ref: np.ndarray, orders: int, only_where_reference: bool = False) -> list[int]:
    """For each order: clipped matches, n-grams of the prediction, of the reference.

    Units are numbers.  An n-gram is the number of its first n - 1 units' n-gram and
    its last unit, numbered anew, so equal numbers are equal n-grams.
    ``only_where_reference`` leaves out a prediction's n-grams of an order that its
    reference lacks.
    """
    units = np.unique(np.concatenate([hyp, ref]), return_inverse=True)[1]
    h1, r1 = units[: len(hyp)], units[len(hyp) :]
    kinds = int(units.max(initial=-1)) + 1
    h, r, out = h1, r1, []
    for n in range(1, orders + 1):
        if n > 1:
            h = h[: max(0, len(h1) - n + 1)] * kinds + h1[n - 1 :]
            r = r[: max(0, len(r1) - n + 1)] * kinds + r1[n - 1 :]
            both = np.unique(np.concatenate([h, r]), return_inverse=True)[1]
            h, r = both[: len(h)], both[len(h) :]
        match = 0
        if len(h) and len(r):
            size = int(max(h.max(), r.max())) + 1
            match = int(np.minimum(np.bincount(h, minlength=size), np.bincount(r, minlength=size)).sum())
        out += [match, len(h) if len(r) or not only_where_reference else 0, len(r)]
    return out


def _word_counts(hyps: pd.Series, refs: pd.Series) -> pd.Series:
    rows = []
    for hyp, ref in zip(hyps, refs):
        number: dict[str, int] = {}
        a, b = ([number.setdefault(t, len(number)) for t in side] for side in (hyp, ref))
        rows.append(clipped_counts(np.array(a, np.int64), np.array(b, np.int64), BLEU_ORDER))
    return pd.Series(rows)


def _char_counts(hyps: pd.Series, refs: pd.Series) -> pd.Series:
    points = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64)
    return pd.Series([clipped_counts(points(h), points(r), CHRF_ORDER, True) for h, r in zip(hyps, refs)])


def _counts(rows: DataFrame, by: list[str], orders: range, counter) -> DataFrame:
    """One row a group: ``match_n, hyp_n, ref_n`` for each order.

    A row's n-grams are counted where the row is; only partial sums are shuffled.
    """
    count = F.pandas_udf(counter, "array<long>")
    names = [f"{c}_{n}" for n in orders for c in ("match", "hyp", "ref")]
    sums = [F.coalesce(F.sum(F.get("_c", F.lit(i))), F.lit(0)).alias(name) for i, name in enumerate(names)]
    return rows.select(*by, count("_p", "_r").alias("_c")).groupBy(*by).agg(*sums)


def _prepared(rows: DataFrame, by: list[str], prediction: str, target: str, cut) -> DataFrame:
    clean = lambda c: cut(strip(F.coalesce(F.col(c), F.lit(""))))
    return rows.select(*by, clean(prediction).alias("_p"), clean(target).alias("_r"))


def bleu_score(match: list[Column], total: list[Column], hyp: Column, ref: Column) -> Column:
    """Exponential smoothing of orders without a match; an order without n-grams gives 0."""
    zeros = [(m == 0).cast("int") for m in match]
    logs = []
    for i, (m, t) in enumerate(zip(match, total)):
        smooth = F.pow(F.lit(2.0), reduce(lambda a, b: a + b, zeros[: i + 1]))
        p = F.when(m > 0, 100.0 * m / F.nullif(t, F.lit(0))).otherwise(100.0 / (smooth * F.nullif(t, F.lit(0))))
        logs.append(F.log(p))
    brevity = F.when(hyp >= ref, F.lit(1.0)).otherwise(F.exp(1.0 - ref / F.nullif(hyp, F.lit(0))))
    mean = F.exp(reduce(lambda a, b: a + b, logs) / len(logs))
    none = reduce(lambda a, b: a & b, [m == 0 for m in match]) | reduce(lambda a, b: a | b, [t == 0 for t in total])
    return F.when(none, F.lit(0.0)).otherwise(brevity * mean)


def corpus_bleu(rows: DataFrame, by: list[str] | None = None, prediction: str = "prediction", target: str = "target") -> DataFrame:
    """``by, bleu`` (0 to 100, four digits)."""
    by, orders = by or [], range(1, BLEU_ORDER + 1)
    wide = _counts(_prepared(rows, by, prediction, target, tokens_13a), by, orders, _word_counts)
    get = lambda c: [F.col(f"{c}_{n}") for n in orders]
    score = bleu_score(get("match"), get("hyp"), F.col("hyp_1"), F.col("ref_1"))
    return wide.select(*by, F.round(score, DIGITS).alias("bleu"))


def corpus_chrf(rows: DataFrame, by: list[str] | None = None, prediction: str = "prediction", target: str = "target") -> DataFrame:
    """``by, chrf`` (0 to 100, four digits)."""
    by, orders = by or [], range(1, CHRF_ORDER + 1)
    wide = _counts(_prepared(rows, by, prediction, target, without_space), by, orders, _char_counts)
    total = lambda cs: reduce(lambda a, b: a + b, cs)
    both = [(F.col(f"hyp_{n}") > 0) & (F.col(f"ref_{n}") > 0) for n in orders]
    ratio = lambda n, c: F.when(both[n - 1], F.col(f"match_{n}") / F.nullif(F.col(f"{c}_{n}"), F.lit(0))).otherwise(0.0)
    used = F.nullif(total([b.cast("int") for b in both]), F.lit(0))
    p, r = total([ratio(n, "hyp") for n in orders]) / used, total([ratio(n, "ref") for n in orders]) / used
    square = float(BETA * BETA)
    score = 100.0 * (1 + square) * p * r / F.nullif(square * p + r, F.lit(0.0))
    return wide.select(*by, F.round(F.coalesce(score, F.lit(0.0)), DIGITS).alias("chrf"))


def evaluate(rows: DataFrame, by: list[str] | None = None, prediction: str = "prediction", target: str = "target") -> DataFrame:
    """``by, bleu, chrf``; every group of ``rows`` has a row."""
    bleu, chrf = corpus_bleu(rows, by, prediction, target), corpus_chrf(rows, by, prediction, target)
    if not by:
        return bleu.join(chrf, F.lit(True))  # one row each
    groups = rows.select(*by).distinct()
    return groups.join(bleu, by, "left").join(chrf, by, "left").fillna(0.0, ["bleu", "chrf"])
