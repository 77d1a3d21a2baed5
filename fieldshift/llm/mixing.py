"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed per cell of source, language and topic; the cells are raked until their marginals meet the
targets; a document is then kept with a probability that follows from its cell's weight. Where a cell would need more
than it holds, it is kept whole and the other cells are raked again around it, so that the expected tokens per source,
language and topic have the target shares.

Where no targets are given, they are the observed shares tempered by a power, but no value's target is more than its
tokens can make up in a sample of the asked size: such a value is kept whole and the others share the rest in proportion.
Given targets that the tokens can't make up, singly or together, raise an error, unless ``strict`` is off; tempered ones
that can't be met together are missed as little as the rounds reach. What is missed is logged, and :func:`shares` gives
all targets beside what is expected. Only sums per cell are gathered, never documents.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import BLANKS, bind
from .support import discard, materialize

DIMENSIONS = ("source", "lang", "topic")
#: Exponents by which observed shares become targets where none are given: 1 keeps them, 0 levels them.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Share of all tokens that the sample is expected to hold.
FRACTION = 0.7
SEED = 17
ROUNDS, CLUSTER_ROUNDS, TOLERANCE = 2000, 60, 1e-9
#: With no more cells than this, rounds run on the driver over arrays, else as grouped sums in the cluster.
MOST_LOCAL_CELLS = 200_000
#: Bound of what calibration multiplies a probability by before it is cut at 1.
MOST_FACTOR = 1e9
#: A share that misses its target by more is logged, or an error where targets are given.
MISSED = 1e-4
#: From here a cell counts as whole, so that sums in another order don't decide what is fixed.
WHOLE = 1 - 1e-9

log = logging.getLogger(__name__)

Targets = Mapping[str, Mapping[str | None, float]]


class Infeasible(ValueError):
    """Given targets that a sample of the asked size can't have."""


def token_count(text: Column) -> Column:
    """Words that ASCII white space separates; 0 for null."""
    return bind(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)),
        lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, "[ \\t-\\r]+"))).cast("long"),
    )


def surface_topic(text: Column) -> Column:
    """A topic by what the text looks like, for tables that have no topic column."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(F.lower(t), F.lit("licens")), F.lit("licensed"))
        .when(F.contains(t, F.lit(" | ")), F.lit("tabular"))
        .when(t.rlike(r"[#$%&*]{3}"), F.lit("symbolic"))
        .when(F.char_length(t) >= 5000, F.lit("long prose"))
        .otherwise(F.lit("prose"))
    )


def describe(docs: DataFrame, topic: Column | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with source, lang, topic and n_tokens; other columns are left out."""
    text = F.col(f"`{text_col}`")
    return docs.select(
        *[F.col(f"`{c}`") for c in keep],
        "source",
        "lang",
        (surface_topic(text) if topic is None else topic).alias("topic"),
        token_count(text).alias("n_tokens"),
    )


def cell_sums(described: DataFrame) -> DataFrame:
    return described.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def _shares(values: list, tokens: np.ndarray, power: float, given: Mapping[str | None, float] | None) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's value, and the target share of each value; values without tokens get none."""
    names = sorted(set(values), key=lambda v: (v is not None, v))
    at = {v: i for i, v in enumerate(names)}
    index = np.array([at[v] for v in values], np.int64)
    mass = np.bincount(index, tokens, len(names))
    want = np.array([given.get(v, 0.0) for v in names]) if given is not None else np.where(mass > 0, mass, 1.0) ** power
    want = np.where(mass > 0, want, 0.0)
    return index, want / want.sum() if want.sum() else want


def _within(tokens: np.ndarray, index: np.ndarray, want: np.ndarray, budget: float) -> np.ndarray:
    """The targets, or what the tokens of each value can make up of a sample of ``budget`` tokens."""
    held = np.bincount(index, tokens, len(want))
    goal = held * _probabilities(np.divide(want, held, out=np.zeros_like(want), where=held > 0), held, budget)
    return goal / goal.sum() if goal.sum() else want


def _rake_locally(rows: list, targets: Targets, fraction: float, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    tokens = np.array([r.tokens for r in rows])
    total = tokens.sum()
    mass = tokens / total if total else tokens
    asked = [_shares([r[d] for r in rows], tokens, TEMPER[d], targets.get(d)) for d in DIMENSIONS]
    dims = [(index, _within(tokens, index, want, fraction * total)) for index, want in asked]
    for _ in range(ROUNDS):
        worst = 0.0
        for index, want in dims:
            have = np.bincount(index, mass, len(want))
            factor = np.divide(want, have, out=np.zeros_like(want), where=have > 0)
            worst = max(worst, float(np.abs(have - want).max(initial=0)))
            mass = mass * factor[index]
        if worst < TOLERANCE:
            break
    weight = np.divide(mass * total, tokens, out=np.zeros_like(mass), where=tokens > 0)
    p = _calibrate(weight, tokens, dims, fraction * total)
    if p @ tokens:
        missed = []
        for d, (index, want), (_, within) in zip(DIMENSIONS, asked, dims):
            expected = np.bincount(index, p * tokens, len(want)) / (p @ tokens)
            names = {i: r[d] for i, r in zip(index.tolist(), rows)}
            goal = want if d in targets else within
            missed += [(d, names[i], goal[i], expected[i]) for i in np.flatnonzero(np.abs(goal - expected) > MISSED)]
        _tell(missed, strict and bool(targets))
    return weight, p


def _tell(missed: list, strict: bool) -> None:
    if not missed:
        return
    lines = [f"{d} {value!r}: {expected:.5f} of the sample expected, target {want:.5f}" for d, value, want, expected in missed]
    if strict:
        raise Infeasible("targets that tokens can't make up at this fraction: " + "; ".join(lines[:20]))
    for line in lines:
        log.warning(line)


def _calibrate(weight: np.ndarray, tokens: np.ndarray, dims: list, budget: float) -> np.ndarray:
    """min(1, weight times a factor per source, language and topic) with the marginals of ``dims``, as far as tokens go."""
    now = weight * _scale(weight, tokens, budget)
    for _ in range(ROUNDS):
        worst = 0.0
        for index, want in dims:
            goal = want * budget
            full = np.bincount(index, np.where(now >= WHOLE, tokens, 0.0), len(goal))
            free = np.bincount(index, np.where(now < WHOLE, now * tokens, 0.0), len(goal))
            have = full + free
            worst = max(worst, float(np.abs(have - goal).max(initial=0)) / budget if budget else 0.0)
            # with the full cells fixed if the free ones can do it, else all of them
            alone = (goal > full) & (free > 0)
            with np.errstate(over="ignore"):
                factor = np.divide(np.where(alone, goal - full, goal), np.where(alone, free, have), out=np.zeros_like(goal), where=have > 0)
            now = np.minimum(now * np.minimum(factor, MOST_FACTOR)[index], MOST_FACTOR)
        if worst < TOLERANCE:
            break
    return _probabilities(now, tokens, budget)


def _scale(weight: np.ndarray, tokens: np.ndarray, budget: float) -> float:
    free = weight @ tokens
    return budget / free if free > 0 else 0.0


def _probabilities(weight: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """min(1, c * weight) with c such that the expected tokens are the budget, if the weighted cells hold as many."""
    full = np.zeros(len(weight), bool)
    scale = 0.0
    for _ in range(len(weight) + 1):
        free = weight[~full] @ tokens[~full]
        scale = (budget - tokens[full].sum()) / free if free > 0 else 0.0
        over = ~full & (scale * weight >= 1)
        if not over.any():
            break
        full |= over
    return np.where(full, 1.0, np.minimum(1.0, np.maximum(0.0, scale * weight)))


def _wants(cells: DataFrame, targets: Targets, budget: float) -> dict[str, DataFrame]:
    """Per dimension (v, asked, want): the share asked for each value with tokens, and what its tokens can make up."""
    spark = cells.sparkSession
    wants = {}
    for d in DIMENSIONS:
        sums = cells.groupBy(F.col(d).alias("v")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
        if targets.get(d) is not None:
            given = spark.createDataFrame(list(targets[d].items()), "g string, share double")
            sums = sums.join(given, F.col("v").eqNullSafe(F.col("g")), "left").select("v", "tokens", F.coalesce("share", F.lit(0.0)).alias("share"))
        else:
            sums = sums.withColumn("share", F.pow("tokens", F.lit(TEMPER[d])))
        whole = sums.agg(F.sum("share")).first()[0] or 1.0
        asked = materialize(sums.select("v", "tokens", (F.col("share") / F.lit(whole)).alias("asked"), (F.col("share") / F.lit(whole) / F.col("tokens")).alias("weight")), "targets")
        scale = _scale_in_cluster(asked, budget)
        goal = F.col("tokens") * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("weight") * F.lit(scale)))
        goals = asked.agg(F.sum(goal)).first()[0] or 0.0
        wants[d] = materialize(asked.select("v", "asked", (goal / F.lit(goals) if goals else F.col("asked")).alias("want")), "targets")
    return wants


def _scale_in_cluster(table: DataFrame, budget: float) -> float:
    """c by which the tokens times min(1, c * weight) of ``table`` (tokens, weight) sum to the budget, if it holds as many."""
    scale = None
    for _ in range(100):
        over = F.lit(False) if scale is None else F.col("weight") * F.lit(scale) >= 1
        full, free = table.agg(F.sum(F.when(over, F.col("tokens"))), F.sum(F.when(~over, F.col("tokens") * F.col("weight")))).first()
        fresh = (budget - (full or 0.0)) / free if free else 0.0
        if scale is not None and fresh <= scale:
            break
        scale = fresh
    return scale or 0.0


def _calibrate_in_cluster(weighted: DataFrame, wants: dict[str, DataFrame], budget: float) -> DataFrame:
    """``weighted`` (source, lang, topic, tokens, weight) with what :func:`_calibrate` computes as probability."""
    cut = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    sums = weighted.agg(F.sum(F.col("weight") * F.col("tokens"))).first()[0]
    now = materialize(weighted.withColumn("now", F.col("weight") * F.lit(budget / sums if sums else 0.0)), "calibrating")
    goals = {d: wants[d].select("v", (F.col("want") * F.lit(budget)).alias("goal")) for d in DIMENSIONS}
    free, full, goal = F.col("free"), F.col("full"), F.col("goal")
    for _ in range(CLUSTER_ROUNDS):
        worst, before = 0.0, now
        for d in DIMENSIONS:
            have = now.groupBy(d).agg(
                F.sum(F.when(F.col("now") >= WHOLE, F.col("tokens")).otherwise(0.0)).alias("full"),
                F.sum(F.when(F.col("now") < WHOLE, F.col("tokens") * F.col("now")).otherwise(0.0)).alias("free"),
            )
            alone = (goal > full) & (free > 0)
            factor = F.when(alone, (goal - full) / F.nullif(free, F.lit(0.0))).when(full + free > 0, goal / F.nullif(full + free, F.lit(0.0)))
            both = materialize(
                have.withColumnRenamed(d, "v").alias("h").join(goals[d].alias("g"), F.col("h.v").eqNullSafe(F.col("g.v")), "left")
                .withColumn("goal", F.coalesce(goal, F.lit(0.0)))
                .select(F.col("h.v").alias("v"), F.coalesce(factor, F.lit(0.0)).alias("factor"), F.abs(full + free - goal).alias("off")),
                "factors",
            )
            worst = max(worst, (both.agg(F.max("off")).first()[0] or 0.0) / budget if budget else 0.0)
            now = now.join(both, now[d].eqNullSafe(both.v)).select(
                *DIMENSIONS, "tokens", "weight", F.least(F.col("now") * F.col("factor"), F.lit(MOST_FACTOR)).alias("now")
            )
        now = materialize(now, "calibrating")
        discard(before)
        if worst < TOLERANCE:
            break
    scale = _scale_in_cluster(now.select("tokens", F.col("now").alias("weight")), budget)
    return now.select(*DIMENSIONS, "tokens", "weight", cut(F.col("now") * F.lit(scale)).alias("probability"))


def _rake_in_cluster(cells: DataFrame, targets: Targets, fraction: float, strict: bool) -> DataFrame:
    """The same rounds as grouped sums and joins, each round written to the shared folder."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    now = materialize(cells.withColumn("mass", F.col("tokens") / F.lit(total or 1.0)), "raking")
    wants = _wants(cells, targets, fraction * total)
    for _ in range(CLUSTER_ROUNDS):
        worst, before = 0.0, now
        for d in DIMENSIONS:
            have = now.groupBy(d).agg(F.sum("mass").alias("have")).withColumnRenamed(d, "v")
            both = materialize(
                have.alias("h").join(wants[d].alias("w"), F.col("h.v").eqNullSafe(F.col("w.v")), "left").select(
                    F.col("h.v").alias("v"), "have", F.coalesce("want", F.lit(0.0)).alias("want")
                ),
                "factors",
            )
            worst = max(worst, both.agg(F.max(F.abs(F.col("have") - F.col("want")))).first()[0] or 0.0)
            factor = F.when(F.col("have") > 0, F.col("want") / F.nullif(F.col("have"), F.lit(0.0))).otherwise(0.0)
            now = now.join(both, now[d].eqNullSafe(both.v)).select(*DIMENSIONS, "tokens", (F.col("mass") * factor).alias("mass"))
        now = materialize(now, "raking")
        discard(before)
        if worst < TOLERANCE:
            break
    weighted = now.select(
        *DIMENSIONS, "tokens", F.when(F.col("tokens") > 0, F.col("mass") * total / F.nullif("tokens", F.lit(0.0))).otherwise(0.0).alias("weight")
    )
    found = materialize(_calibrate_in_cluster(materialize(weighted, "weighted"), wants, fraction * total), "weights")
    missed = _compare(found, wants, targets).where(F.abs(F.col("target") - F.col("expected")) > MISSED)
    _tell([tuple(r) for r in missed.orderBy(F.col("expected") - F.col("target")).limit(100).collect()], strict and bool(targets))
    return found.select(*DIMENSIONS, "weight", "probability")


def _compare(found: DataFrame, wants: dict[str, DataFrame], targets: Targets) -> DataFrame:
    whole = found.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0] or 1.0
    parts = []
    for d in DIMENSIONS:
        have = found.groupBy(F.col(d).alias("v")).agg((F.sum(F.col("tokens") * F.col("probability")) / F.lit(whole)).alias("expected"))
        both = have.alias("h").join(wants[d].alias("w"), F.col("h.v").eqNullSafe(F.col("w.v")), "left")
        target = F.col("asked" if d in targets else "want")
        parts.append(both.select(F.lit(d).alias("dimension"), F.col("h.v").cast("string").alias("value"), F.coalesce(target, F.lit(0.0)).alias("target"), "expected"))
    return reduce(DataFrame.union, parts)


def shares(cells: DataFrame, table: DataFrame, targets: Targets | None = None, fraction: float = FRACTION) -> DataFrame:
    """(dimension, value, target, expected): shares of the sample that :func:`weights` gives ``table`` for ``cells``."""
    same = reduce(lambda a, b: a & b, [cells[d].eqNullSafe(table[d]) for d in DIMENSIONS])
    found = cells.join(table, same).select(*[cells[d] for d in DIMENSIONS], "tokens", "probability")
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    return _compare(found, _wants(cells, targets or {}, fraction * total), targets or {})


def weights(cells: DataFrame, targets: Targets | None = None, fraction: float = FRACTION, strict: bool = True) -> DataFrame:
    """(source, lang, topic, weight, probability) per cell; a value that targets don't name has share 0.

    The weight is the factor by which raking changes the cell's tokens. Cells that can't supply what their weight asks
    for are kept whole and the others are calibrated to the targets around them, so the sample's expected size holds and
    so do the shares. Given targets missed by more than ``MISSED`` raise :class:`Infeasible`, or are logged without ``strict``.
    """
    targets = targets or {}
    cells = materialize(cells, "cells")
    if cells.count() > MOST_LOCAL_CELLS:
        return _rake_in_cluster(cells, targets, fraction, strict)
    rows = cells.collect()
    weight, p = _rake_locally(rows, targets, fraction, strict) if rows else ([], [])
    found = [(*[r[d] for d in DIMENSIONS], float(w), float(q)) for r, w, q in zip(rows, weight, p)]
    schema = ", ".join(f"{d} {cells.schema[d].dataType.simpleString()}" for d in DIMENSIONS)
    return cells.sparkSession.createDataFrame(found, f"{schema}, weight double, probability double")


def draw(id_col: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from an id: the same in every run, for repeated ids, and on every executor."""
    return F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def attach(described: DataFrame, table: DataFrame, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """``described`` with weight, probability and kept. Null sources, languages or topics are values like any other."""
    few = len(table.take(MOST_LOCAL_CELLS + 1)) <= MOST_LOCAL_CELLS
    named = table.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "weight", "probability")
    same = F.lit(True)
    for d in DIMENSIONS:
        same = same & F.col(d).eqNullSafe(F.col(f"_{d}"))
    joined = described.join(F.broadcast(named) if few else named, same, "left").drop(*[f"_{d}" for d in DIMENSIONS])
    return joined.withColumn("kept", draw(F.col(id_col), seed) < F.coalesce("probability", F.lit(0.0)))


def mix(docs: DataFrame, targets: Targets | None = None, fraction: float = FRACTION, topic: Column | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability and kept of every row of ``docs``.

    A null text has no tokens; rows with one id share their draw; an empty table gives no row; extra columns are
    ignored. Texts aren't shuffled.
    """
    described = materialize(describe(docs, topic), "described")
    return attach(described, weights(cell_sums(described), targets, fraction), seed)


def sample(docs: DataFrame, targets: Targets | None = None, fraction: float = FRACTION, topic: Column | None = None, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that :func:`mix` keeps, with the columns of ``docs``."""
    table = materialize(weights(cell_sums(describe(docs, topic, keep=())), targets, fraction), "weights")
    named = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "source", "lang")
    return attach(describe(named, topic, keep=("_row", "doc_id")), table, seed).where("kept").select("_row.*")
