"""Filling containers of fixed capacity with texts, by patterns of lengths."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_folder

CAPACITY = 2048
UNIT = 4  # tokens of a length class; lengths are rounded up to it
FEW = 8  # documents of a pattern
ROWS_PER_SALT = 250_000


def least_squares(a: np.ndarray, h: np.ndarray, x0: np.ndarray) -> np.ndarray:
    """min |a x - h| over x >= 0 by projected coordinate steps on the normal equations, from x0 (active set kept small)."""
    g, b = a.T @ a, a.T @ h
    x, diagonal = x0.copy(), np.maximum(g.diagonal(), 1e-12)
    for _ in range(60):
        before = x.copy()
        for j in range(len(x)):
            x[j] = max(0.0, x[j] + (b[j] - g[j] @ x) / diagonal[j])
        if np.abs(x - before).max(initial=0) < 1e-3 * max(1.0, x.max(initial=0)):
            break
    return x


def best_pattern(worth: np.ndarray, capacity: int, few: int) -> tuple[np.ndarray, float]:
    """The pattern of at most `few` lengths that fills `capacity` exactly and has the greatest summed worth.

    It searches all such patterns at once: a knapsack over (documents used, units filled). worth[s] is of length s >= 1.
    """
    sizes = np.flatnonzero(np.isfinite(worth[1:])) + 1
    value = np.full((few + 1, capacity + 1), -np.inf)
    took = np.zeros((few + 1, capacity + 1), np.int64)
    value[0, 0] = 0
    before = np.arange(capacity + 1)[None, :] - sizes[:, None]  # units filled before a document of each size
    for k in range(1, few + 1 if len(sizes) else 1):
        new = np.where(before >= 0, value[k - 1][np.maximum(before, 0)], -np.inf) + worth[sizes][:, None]
        best_size = new.argmax(0)
        value[k] = new[best_size, np.arange(capacity + 1)]
        took[k] = np.where(np.isfinite(value[k]), sizes[best_size], 0)
    k = int(np.argmax(value[:, capacity]))
    pattern, at, best = np.zeros(capacity + 1), capacity, float(value[k, capacity])
    if not np.isfinite(best):
        return pattern, -np.inf
    while k:
        s = took[k, at]
        pattern[s] += 1
        at, k = at - s, k - 1
    return pattern, best


def fit_patterns(histogram: np.ndarray, capacity: int, few: int = FEW, rounds: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, repeats): patterns of few lengths whose non-negative repeats fit the histogram in least squares.

    Patterns enter one at a time, as in active-set non-negative least squares: always the one whose gradient is steepest,
    out of all that fill a container. Repeats are then rounded down so that no length is used more often than it occurs.
    """
    h = histogram.astype(float)
    columns: list[np.ndarray] = []
    x = np.zeros(0)
    rest = h.copy()
    for _ in range(rounds):
        worth = np.where(h > 0, rest / np.sqrt(np.maximum(h, 1)), np.nan)
        worth = np.where(np.isnan(worth), -np.inf, worth)
        worth[0] = -np.inf
        p, gain = best_pattern(worth, capacity, few)
        if not gain > 1e-6 * np.sqrt(h.sum() + 1) or any((p == c).all() for c in columns):
            break
        columns.append(p)
        weight = 1 / np.sqrt(np.maximum(h, 1))
        a = np.stack(columns, 1)
        x = least_squares(a * weight[:, None], h * weight, np.append(x, 0.0))
        rest = h - a @ x
        if np.abs(rest).sum() < 0.002 * h.sum():
            break
    left = histogram.astype(np.int64).copy()
    repeats = np.zeros(len(columns), np.int64)
    for j in np.argsort(-x, kind="stable"):
        use = columns[j] > 0
        repeats[j] = min(int(x[j]), int((left[use] // columns[j][use].astype(np.int64)).min()))
        left -= repeats[j] * columns[j].astype(np.int64)
    return (np.stack(columns) if columns else np.zeros((0, capacity + 1))), repeats


@dataclass
class Plan:
    """For each length class the runs (from rank, first container, how many) and the number of containers."""

    runs: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    containers: int = 0
    used: dict[int, int] = field(default_factory=dict)

    def put(self, pattern: dict[int, int], times: int) -> None:
        """`times` containers in a row, each with these lengths."""
        for size, n in pattern.items():
            for _ in range(n):
                at = self.used.get(size, 0)
                self.runs.setdefault(size, []).append((at, self.containers, times))
                self.used[size] = at + times
        self.containers += times


def plan_containers(histogram: np.ndarray, capacity: int, few: int = FEW) -> Plan:
    """A plan for all lengths of a histogram over 1..capacity: fitted patterns, then the rest by best-fit decreasing.

    The rest is packed by counts, longest length first into the fullest containers that it fits, so the work depends on
    the number of length classes and never on the number of documents.
    """
    plan = Plan()
    patterns, repeats = fit_patterns(histogram, capacity, few)
    left = histogram.astype(np.int64).copy()
    for p, n in zip(patterns, repeats):
        if n:
            plan.put({int(s): int(p[s]) for s in np.flatnonzero(p)}, int(n))
            left -= n * p.astype(np.int64)
    open_: dict[int, list[list]] = {}  # space left -> [contents, times]
    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            space = next((s for s in range(size, capacity + 1) if open_.get(s)), None)
            if space is None:
                fit = capacity // size
                full, some = divmod(n, fit)
                if full:
                    open_.setdefault(capacity - fit * size, []).append([{size: fit}, full])
                if some:
                    open_.setdefault(capacity - some * size, []).append([{size: some}, 1])
                break
            contents, times = open_[space].pop()
            fit = min(space // size, max(1, n // times))
            if n < times:
                open_[space].append([contents, times - n])
                times = n
            n -= fit * times
            open_.setdefault(space - fit * size, []).append([contents | {size: contents.get(size, 0) + fit}, times])
    for groups in open_.values():
        for contents, times in groups:
            plan.put(contents, times)
    return plan


def pack(lengths: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, few: int = FEW) -> DataFrame:
    """doc_id, piece, token_start, n_tokens and container_id of each text of `lengths` (doc_id, n_tokens).

    A text longer than the capacity, and no other, is split: full pieces, then its remainder. Texts without tokens (also
    null lengths) take no space and are dealt to the containers in turn. No container exceeds the capacity; every row
    comes out, repeated doc_ids too; an empty table gives no rows.

    Only the histogram of length classes (capacity / unit counts) reaches the driver, where patterns of at most `few`
    documents are fitted to it. A document finds its container from its rank among those of its class; ranks come from
    salted windows and the salts' counts, so a class that holds most documents is still ranked in parts. The lengths are
    written once to the shared folder, so they are not computed again for each use.
    """
    spark = lengths.sparkSession
    path = shared_folder(spark, "lengths")
    lengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens")).write.parquet(path)
    stored = spark.read.parquet(path)
    full = F.floor(F.col("n_tokens") / capacity)
    last = F.when((F.col("n_tokens") % capacity > 0) | (F.col("n_tokens") == 0), full).otherwise(full - 1)
    items = stored.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    items = items.select("doc_id", "piece", (F.col("piece") * capacity).alias("token_start"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece") * capacity).alias("n_tokens"))
    items = items.withColumn("class", F.ceil(F.col("n_tokens") / unit).cast("int"))

    slots = capacity // unit
    counts = {r["class"]: r["n"] for r in items.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    histogram = np.zeros(slots + 1, np.int64)
    for c, n in counts.items():
        histogram[c] = n
    histogram[0] = 0  # texts without tokens take no space
    plan = plan_containers(histogram, slots, few)

    salts = max(8, -(-sum(counts.values()) // ROWS_PER_SALT))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    per_salt = salted.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = per_salt.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("class", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = salted.withColumn("own", F.row_number().over(Window.partitionBy("class", "salt").orderBy("doc_id", "piece")) - 1).join(before, ["class", "salt"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before"))

    runs = [(c, [(a, b, n) for a, b, n in sorted(rs)]) for c, rs in plan.runs.items()]
    table = spark.createDataFrame(runs, "class int, runs array<struct<start: bigint, container: bigint, n: bigint>>")
    hit = F.filter("runs", lambda r: (r["start"] <= F.col("rank")) & (F.col("rank") < r["start"] + r["n"]))[0]
    placed = ranked.join(F.broadcast(table), "class", "left")  # bounded: a row for each length class
    container = F.when(F.col("class") == 0, F.col("rank") % max(plan.containers, 1)).otherwise(hit["container"] + F.col("rank") - hit["start"])
    return placed.select("doc_id", "piece", "token_start", "n_tokens", container.alias("container_id"))


def container_fill(packed: DataFrame) -> DataFrame:
    """container_id, documents and tokens of each container."""
    return packed.groupBy("container_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
