"""Mixing documents to target domain weights by soft membership.

A naive Bayes classifier over hashed words, fitted on at most
``labelled_rows`` rows of a labelled table, gives each document a posterior for
each domain.  Nonnegative rates r then minimise

    sum_c (sum_i r_i n_i p_ic - T_c)^2 / (2 N E_c / N)  +  mu/2 sum_i n_i/N (r_i - 1)^2

by projected gradient steps (n: words, p: posteriors, E: expected words of a
domain at r = 1, T: its target, N: all words).  A step needs the sums of r n p
over all documents.  They are taken over cells: documents whose posteriors round
to the same multiples of 1/``grid`` follow the same steps and share a rate, and
a cell carries the exact sums of its documents, so the totals are exact and a
step reads at most ``_MOST_CELLS`` rows whatever the corpus.  A document of rate
r stays floor(r) times, and once more with probability r - floor(r), drawn from
a hash of the row.

Only column expressions are used; texts are scored once.  Defined results: a
null or empty text has no words, the prior as its posterior, and takes part;
repeated rows are mixed alike; a domain without labelled rows has smoothed
counts only; a domain without expected words can't meet its target and leaves
the others as they are; targets that the steps don't reach, as those of a domain
that no document belongs to clearly, give a warning with the distance left; a corpus without words keeps every rate at 1; an empty
table gives an empty table; other columns stay, but ``n_words``, ``p_<domain>``,
``rate`` and ``copies`` are replaced.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

_SPACE = r"[\x20\x09-\x0D]+"
_MOST_CELLS = 10_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE, -1), "")


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def _summed(indices: str, values: Column) -> Column:
    return F.aggregate(indices, F.lit(0.0), lambda total, k: total + F.get(values, k))


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], *, id_col: str = "doc_id", text_col: str = "text", labelled_rows: int = 4000, buckets: int = 4096, smoothing: float = 0.5) -> tuple[dict[str, float], dict[str, list[float]]]:
    """Log prior and log word likelihoods of each domain; ``labels`` has id_col and domain."""
    known = labels.where(F.col("domain").isin(domains) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_l"), "domain").distinct()
    chosen = F.broadcast(known.orderBy(F.xxhash64("_l"), "_l", "domain").limit(labelled_rows))  # at most labelled_rows rows
    held = materialize(docs.select(F.col(id_col).alias("_l"), F.col(text_col).alias("_w")).join(chosen, "_l").select("domain", _words(F.col("_w")).alias("words")), "labelled")
    rows = {r[0]: r[1] for r in held.groupBy("domain").count().collect()}
    counts = held.select("domain", F.explode("words").alias("w")).groupBy("domain", _bucket(F.col("w"), buckets).alias("b")).count()
    table = {c: [smoothing] * buckets for c in domains}
    for domain, b, n in counts.collect():  # at most domains * buckets rows
        table[domain][b] += n
    prior = {c: math.log((rows.get(c, 0) + smoothing) / (sum(rows.values()) + smoothing * len(domains))) for c in domains}
    return prior, {c: [math.log(x / total) for x in own] for c, own in table.items() if (total := sum(own))}


def _numbers(values: list[float]) -> Column:
    """A constant array as one literal, for an array of literals would be a node each in every plan that uses it."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def posteriors(docs: DataFrame, prior: Mapping[str, float], likelihood: Mapping[str, list[float]], *, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words and p_<domain>."""
    domains = list(prior)
    base, others = domains[0], domains[1:]
    buckets = len(likelihood[base])
    out = docs.drop("n_words", *(f"p_{c}" for c in domains))
    out = out.withColumn("_b", F.transform(_words(F.col(text_col)), lambda w: _bucket(w, buckets))).withColumn("n_words", F.size("_b").cast("long"))
    for c in others:
        odds = _numbers([a - b for a, b in zip(likelihood[c], likelihood[base], strict=True)])
        total = _summed("_b", odds)
        out = out.withColumn(f"_z_{c}", F.least(F.lit(300.0), F.greatest(F.lit(-300.0), total + (prior[c] - prior[base]))))
    out = out.drop("_b")
    norm = sum((F.exp(f"_z_{c}") for c in others), F.lit(1.0))
    for c in others:
        out = out.withColumn(f"p_{c}", F.exp(f"_z_{c}") / norm)
    return out.withColumn(f"p_{base}", F.lit(1.0) / norm).drop(*(f"_z_{c}" for c in others))


def _rounded(domains: list[str], grid: int) -> list[Column]:
    """Posteriors as multiples of 1/grid that sum to 1."""
    others = [F.floor(F.col(f"p_{c}") * grid + 0.5 / len(domains)).cast("int") for c in domains[1:]]
    return [(F.lit(grid) - sum(others, F.lit(0))), *others]


def _rate(q: list[Column], grid: int, pulls: list[float], mu: float) -> Column:
    """The rate after the steps whose pulls on each domain are given one after the other."""
    if not pulls:
        return F.lit(1.0)
    held, d = _numbers(pulls), len(q)

    def step(r: Column, k: Column) -> Column:
        slope = sum((F.get(held, k * d + j) * (x / F.lit(float(grid))) for j, x in enumerate(q)), F.lit(mu) * (r - 1))
        return F.greatest(F.lit(0.0), r - slope)

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(pulls) // d - 1)), F.lit(1.0), step)


def rates(scored: DataFrame, weights: Mapping[str, float], *, total_words: float | None = None, grid: int = 50, steps: int = 80, tolerance: float = 1e-4, mu: float = 1e-5) -> Column:
    """The rate of a row of ``scored`` (n_words, p_<domain>) as a column.

    Targets share out ``total_words`` (if none is given, those of the corpus) in
    proportion to ``weights``.
    """
    domains = list(weights)
    d = len(domains)
    while math.comb(grid + d - 1, d - 1) > _MOST_CELLS and grid > 1:
        grid -= 1
    names, own = [f"q{j}" for j in range(d)], [f"s{j}" for j in range(d)]
    words = F.col("n_words").cast("double")
    cells = scored.select(*(x.alias(n) for x, n in zip(_rounded(domains, grid), names, strict=True)), words.alias("n"), *((words * F.col(f"p_{c}")).alias(s) for c, s in zip(domains, own, strict=True)))
    cells = materialize(cells.groupBy(*names).agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in own)).coalesce(1), "cells")  # at most _MOST_CELLS rows
    q, pulls = [F.col(n) for n in names], []

    def totals() -> list[float]:
        held = cells.select(_rate(q, grid, pulls, mu).alias("r"), *own)
        return [x or 0.0 for x in held.agg(*(F.sum(F.col("r") * F.col(s)) for s in own)).first()]

    now = totals()
    n = sum(now)
    if not n:
        return F.lit(1.0)
    reachable, share = [x > 0 for x in now], [max(x / n, 1e-6) for x in now]
    target = [weights[c] / sum(weights.values()) * (total_words or n) for c in domains]
    for _ in range(steps):
        if all(abs(a - t) <= tolerance * n for a, t, ok in zip(now, target, reachable, strict=True) if ok):
            break
        pulls += [(a - t) / (n * s) if ok else 0.0 for a, t, s, ok in zip(now, target, share, reachable, strict=True)]
        now = totals()
    else:
        warnings.warn(f"rates are {max(abs(a - t) for a, t in zip(now, target, strict=True)) / n:.2g} of all words off their targets after {steps} steps", stacklevel=2)
    return _rate(_rounded(domains, grid), grid, pulls, mu)


def mix(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with n_words, p_<domain>, rate and copies."""
    docs = docs.drop("rate", "copies")
    prior, likelihood = fit(docs, labels, list(weights), id_col=id_col, text_col=text_col, **options)
    scored = materialize(posteriors(docs, prior, likelihood, text_col=text_col), "scored")
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("mix"), F.col(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return scored.withColumn("rate", rates(scored, weights)).withColumn("copies", F.floor(F.col("rate") + draw))


def replicate(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Every row as often as ``copies`` says."""
    return mixed.where("copies > 0").withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*columns)
