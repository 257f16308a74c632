"""Exact n-tiles over a whole table without sorting it.

Tile borders are the keys at k-1 known ranks. Each border is found by narrowing a key range: a
sample proposes two keys around the wanted rank, one counting pass tells which side of them the
rank lies on. Once a range is small its rows are numbered and the border key is read off. Every
row is then compared with the border keys, so the table itself is neither shuffled nor sorted.
Keys are (value, id): ids are unique, so rows with one hot value still spread over tiles exactly.
The sample only decides how fast ranges shrink, never the result.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from math import sqrt

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from cohortry.functions.staging import stage

SAMPLE_ROWS = 4_000
RANGE_ROWS = 200_000
SPREAD = 3.0  # standard deviations between the wanted rank and the proposed keys


@dataclass(frozen=True)
class Target:
    """The key at 1-based `rank` of `value` lies in (low, high]; `below` keys are <= low."""

    value: str
    rank: int
    below: int
    size: int
    low: Row | None = None
    high: Row | None = None


def tile_ranks(rows: int, tiles: int) -> list[int]:
    """Rank of the last row of every tile but the final one; the first `rows % tiles` get one more."""
    each, extra = divmod(rows, tiles)
    return [each * tile + min(tile, extra) for tile in range(1, tiles)]


class _Keys:
    """Comparable key columns and key literals of one table."""

    def __init__(self, df: DataFrame, id: str):
        self.id = id
        self.types = {field.name: field.dataType for field in df.schema.fields}

    def column(self, value: str) -> Column:
        return F.struct(F.col(value).alias("v"), F.col(self.id).alias("i"))

    def literal(self, value: str, key: Row) -> Column:
        return F.struct(
            F.lit(key["v"]).cast(self.types[value]).alias("v"),
            F.lit(key["i"]).cast(self.types[self.id]).alias("i"),
        )

    def inside(self, target: Target) -> Column:
        test = F.lit(True)
        if target.low is not None:
            test = test & (self.column(target.value) > self.literal(target.value, target.low))
        if target.high is not None:
            test = test & (self.column(target.value) <= self.literal(target.value, target.high))
        return test


def _propose(df: DataFrame, keys: _Keys, targets: list[Target], sample_rows: int, seed: int) -> Row:
    """Two sampled keys around the wanted rank of every target."""
    drawn = df.withColumn("_draw", F.rand(seed))
    picks = []
    for n, t in enumerate(targets):
        share = (t.rank - t.below) / t.size
        picked = keys.inside(t) & (F.col("_draw") < sample_rows / t.size)
        # About `sample_rows` keys: bounded whatever the size of the table.
        keys_sorted = F.sort_array(F.collect_list(F.when(picked, keys.column(t.value))))
        last = F.size(keys_sorted) - 1
        margin = SPREAD * sqrt(share * (1 - share)) * F.sqrt(F.greatest(last, F.lit(1))) + 1
        low = F.greatest(F.floor(last * share - margin), F.lit(0))
        high = F.least(F.ceil(last * share + margin), last)
        picks.append(F.get(keys_sorted, low.cast("int")).alias(f"low{n}"))
        picks.append(F.get(keys_sorted, high.cast("int")).alias(f"high{n}"))
    return drawn.agg(*picks).first()


def _narrow(df: DataFrame, keys: _Keys, targets: list[Target], proposal: Row) -> list[Target]:
    """Count the keys up to each proposed key and keep the part of the range holding the rank."""
    counts = []
    for n, t in enumerate(targets):
        for side in ("low", "high"):
            key = proposal[f"{side}{n}"]
            if key is not None:
                test = keys.inside(t) & (keys.column(t.value) <= keys.literal(t.value, key))
                counts.append(F.count_if(test).alias(f"{side}{n}"))
    if not counts:
        return targets
    counted = df.agg(*counts).first().asDict()
    narrowed = []
    for n, t in enumerate(targets):
        start, upto = t.low, 0
        for side in ("low", "high"):
            key, count = proposal[f"{side}{n}"], counted.get(f"{side}{n}")
            if count is None:
                continue
            if t.rank <= t.below + count:
                narrowed.append(
                    replace(t, low=start, high=key, below=t.below + upto, size=count - upto)
                )
                break
            start, upto = key, count
        else:
            narrowed.append(replace(t, low=start, below=t.below + upto, size=t.size - upto))
    return narrowed


def _read_off(df: DataFrame, keys: _Keys, targets: list[Target]) -> dict[tuple[str, int], Row]:
    """Number the rows of every (small) range and take the row at the wanted rank."""
    values = list(dict.fromkeys(t.value for t in targets))
    hits = F.array_compact(
        F.array(*[F.when(keys.inside(t), F.lit(n)) for n, t in enumerate(targets)])
    )
    rows = df.select(F.explode(hits).alias("_target"), *values, F.col(keys.id).alias("_id"))
    # Each target sorts by its own value only; the others are blanked out.
    for value in values:
        own = [n for n, t in enumerate(targets) if t.value == value]
        rows = rows.withColumn(value, F.when(F.col("_target").isin(own), F.col(value)))
    numbered = rows.withColumn(
        "_row", F.row_number().over(Window.partitionBy("_target").orderBy(*values, "_id"))
    )
    wanted = F.array(*[F.lit(t.rank - t.below) for t in targets])
    found = numbered.filter(F.col("_row") == F.get(wanted, F.col("_target"))).collect()
    return {
        (targets[r["_target"]].value, targets[r["_target"]].rank): Row(
            v=r[targets[r["_target"]].value], i=r["_id"]
        )
        for r in found
    }


def keys_at_ranks(
    df: DataFrame,
    values: list[str],
    ranks: list[int],
    rows: int,
    id: str,
    sample_rows: int = SAMPLE_ROWS,
    range_rows: int = RANGE_ROWS,
) -> dict[tuple[str, int], Row]:
    """Exact (value, id) key at every 1-based rank, ascending, for every value column.

    `df` must return the same rows on every read, with unique ids.
    """
    keys = _Keys(df, id)
    wanted = sorted({rank for rank in ranks if 0 < rank <= rows})
    targets = [Target(value, rank, 0, rows) for value in values for rank in wanted]
    if not targets:
        return {}
    seed, unchanged = 0, 0
    while any(t.size > range_rows for t in targets):
        wide = [t for t in targets if t.size > range_rows]
        before = sum(t.size for t in wide)
        proposal = _propose(df, keys, wide, sample_rows, seed)
        targets = [t for t in targets if t.size <= range_rows]
        narrowed = _narrow(df, keys, wide, proposal)
        unchanged = unchanged + 1 if sum(t.size for t in narrowed) == before else 0
        if unchanged == 4:
            raise ValueError(f"over {range_rows} rows share a value and {id}; ids must be unique")
        targets += narrowed
        seed += 1
    return _read_off(df, keys, targets)


def ntile_scores(
    df: DataFrame,
    scores: Mapping[str, tuple[str, bool]],
    tiles: int,
    id: str = "user_id",
    **limits: int,
) -> DataFrame:
    """Add one n-tile column per entry of `scores`: name -> (value column, reversed?).

    Tiles run from 1 to `tiles` by ascending value, ties by `id`; reversed ones run back.
    """
    fixed = stage(df, "tiles")
    rows = fixed.count()
    ranks = tile_ranks(rows, tiles)
    values = list(dict.fromkeys(value for value, _ in scores.values()))
    found = keys_at_ranks(fixed, values, ranks, rows, id, **limits)
    keys = _Keys(fixed, id)

    def tile(value: str) -> Column:
        number = F.lit(1)
        for rank in ranks:
            if (value, rank) in found:
                border = keys.literal(value, found[value, rank])
                number = number + (keys.column(value) > border).cast("int")
        return number

    return fixed.withColumns(
        {
            name: (F.lit(tiles + 1) - tile(value) if back else tile(value)).cast("long")
            for name, (value, back) in scores.items()
        }
    )
