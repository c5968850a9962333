"""Shuffle without sorting (O4, W6): a keyed permutation of row positions.

A Feistel network over pairs (x mod a, x div a) permutes 0 .. a*b - 1, where a
is just above the root of n and a*b exceeds n by less than a; a place beyond n
walks on until it falls below n.  So each (seed, epoch) has an order of its
own, a row's place in it is an expression of its position, and the row at any
place is found by the inverse, without sorting by a random key.

Defined results: n = 0 has no places; a null position, seed or epoch gives null;
positions outside 0 .. n - 1 give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .splits import row_positions

#: Round numbers are below this prime, so that their squares are longs.
PRIME = (1 << 31) - 1
#: Rounds (an even number).
ROUNDS = 6


def round_key(seed: Column, epoch: Column, number: Column) -> Column:
    return (F.pmod(seed, F.lit(PRIME)) * 48271 + F.pmod(epoch, F.lit(PRIME)) * 16807 + number * 69621) % PRIME


def _mixed(value: Column, key: Column) -> Column:
    """A number below ``PRIME`` from a half and a round's key."""
    t = (value + key) % PRIME
    return ((t * t + key) % PRIME * ((t * 39373 + key) % PRIME) + t) % PRIME


def _whole(x: Column, y: Column) -> Column:
    """x div y, exact for longs (``/`` is a division of doubles)."""
    return F.call_function("div", x, y)


def _network(x: Column, a: Column, b: Column, seed: Column, epoch: Column, inverse: bool) -> Column:
    """One pass over all rounds, by which the halves take turns."""
    halves = F.struct((x % a).alias("left"), _whole(x, a).alias("right"))
    numbers = [F.lit(i).cast("long") for i in (range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS))]
    sign = F.lit(-1 if inverse else 1)

    def turn(s: Column, i: Column) -> Column:
        key = round_key(seed, epoch, i)
        left = F.pmod(s["left"] + sign * _mixed(s["right"], key), a)
        right = F.pmod(s["right"] + sign * _mixed(s["left"], key), b)
        even = i % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["left"]).alias("left"),
                        F.when(even, s["right"]).otherwise(right).alias("right"))

    return F.aggregate(F.array(*numbers), halves, turn, lambda s: s["left"] + s["right"] * a)


def permuted(position: Column, n: Column, seed: Column, epoch: Column, inverse: bool = False) -> Column:
    """The place of ``position`` (0 .. n - 1) in the order of (seed, epoch), or,
    with ``inverse``, the position that stands at that place.  Only the few
    places beyond n walk on, as often as there are such places at most."""
    x, n, seed, epoch = (c.cast("long") for c in (position, n, seed, epoch))
    a = F.floor(F.sqrt(n)).cast("long") + 1
    b = _whole(n + a - 1, a)
    once = lambda v: _network(v, a, b, seed, epoch, inverse)
    # as many steps as there are places beyond n, in two levels; those after the last one needed are a comparison
    turns = F.sequence(F.lit(1).cast("long"), F.ceil(F.sqrt(F.greatest(a * b - n, F.lit(1)))).cast("long"))
    some = lambda v: F.aggregate(turns, v, lambda w, _: F.when(w < n, w).otherwise(once(w)))
    walk = lambda v: F.when(v < n, v).otherwise(
        F.aggregate(turns, v, lambda w, _: F.when(w < n, w).otherwise(some(w))))
    inside = (x >= 0) & (x < n) & seed.isNotNull() & epoch.isNotNull()
    return F.when(inside, F.element_at(F.transform(F.array(once(x)), walk), 1))


def shuffled_epochs(df: DataFrame, order: str, epochs: int, seed: int = 42, name: str = "step") -> DataFrame:
    """Each row once per epoch, at ``step`` = epoch * n + its place in that
    epoch's order, and ``epoch``.  Rows are numbered by ``order`` once; the
    epochs are not sorted."""
    rows = row_positions(df, order, name="_sh_row")
    total = df.select(F.count(F.lit(1))).scalar()
    n = F.col("_sh_n")
    return (rows.withColumn("_sh_n", total)
            .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
            .withColumn(name, F.col("epoch") * n + permuted(F.col("_sh_row"), n, F.lit(seed), F.col("epoch")))
            .drop("_sh_row", "_sh_n"))


def steps_between(df: DataFrame, order: str, start: int, end: int, seed: int = 42, name: str = "step") -> DataFrame:
    """The rows of steps start .. end - 1 of the endless ``shuffled_epochs``:
    the inverse gives the positions wanted, and only these are joined."""
    rows = row_positions(df, order, name="_sh_row")
    total = df.select(F.count(F.lit(1))).scalar()
    steps = df.sparkSession.range(start, end).select(F.col("id").alias(name), total.alias("_sh_n"))
    steps = steps.where("_sh_n > 0").withColumn("epoch", _whole(F.col(name), F.col("_sh_n")))
    wanted = steps.select(name, "epoch", permuted(F.col(name) % F.col("_sh_n"), F.col("_sh_n"), F.lit(seed), F.col("epoch"), inverse=True).alias("_sh_row"))
    return rows.join(wanted, "_sh_row").drop("_sh_row")
