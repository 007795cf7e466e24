"""Global row numbers and a keyed permutation of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

ROUNDS = 6
#: Odd constants of the round function, and what a round adds.
MULTIPLIERS = (40503, 30011, 51283, 26347, 60493, 45533)
LOW_BITS_OF_ID = (1 << 33) - 1


def half_bits(n: int) -> int:
    """The domain of the network is the least power of four of at least n numbers, and at least four."""
    return max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)


def round_keys(seed: int) -> list[int]:
    state, keys = seed & 0x7FFFFFFF, []
    for _ in range(ROUNDS):
        state = (state * 1103515245 + 12345) % (1 << 31)
        keys.append(state % 65536)
    return keys


def network(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    """One pass of the balanced Feistel network over numbers of 2 * bits bits."""
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for key, multiplier in zip(keys, MULTIPLIERS, strict=True):
        mixed = (right + key) * multiplier
        left, right = right, left ^ ((mixed ^ (mixed >> 7)) & mask)
    return (left << bits) | right


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Maps 0..n-1 onto itself: the network, applied again while its result is n or more (cycle walking)."""
    bits, keys = half_bits(n), round_keys(seed)
    out = network(np.asarray(numbers, dtype=np.int64), bits, keys)
    while len(over := np.flatnonzero(out >= n)):
        out[over] = network(out[over], bits, keys)
    return out


def permuted(number: Column, n: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def slots(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(permute(x.to_numpy(np.int64), n, seed))

    return slots(number)


def permutation_sql(numbers: str, n: str, seed: int, rounds_name: str = "walk") -> str:
    """DuckDB common table expressions for the same permutation: ``numbers`` is a table (row_number), ``n`` a scalar query.

    Gives the table ``slots`` (row_number, slot); to be used after WITH RECURSIVE.
    """
    keys = round_keys(seed)
    halves = "h0 AS (SELECT row_number, x >> bits AS l, x & mask AS r, bits, mask, n FROM turn)"
    for i, (key, multiplier) in enumerate(zip(keys, MULTIPLIERS, strict=True)):
        mixed = f"((r + {key}) * {multiplier})"
        halves += f", h{i + 1} AS (SELECT row_number, r AS l, xor(l, xor({mixed}, {mixed} >> 7) & mask) AS r, bits, mask, n FROM h{i})"
    return f"""size_of AS (SELECT n, greatest(1, CAST((CASE WHEN n <= 1 THEN 0 ELSE length(ltrim(bin(n - 1), '0')) END + 1) // 2 AS BIGINT)) AS bits FROM (SELECT CAST(({n}) AS BIGINT) AS n)),
    {rounds_name} AS (
      SELECT row_number, row_number AS x, bits, (CAST(1 AS BIGINT) << bits) - 1 AS mask, n, false AS done FROM {numbers}, size_of
      UNION ALL
      (WITH turn AS (SELECT * FROM {rounds_name} WHERE NOT done), {halves}
       SELECT row_number, (l << bits) | r, bits, mask, n, ((l << bits) | r) < n FROM h{ROUNDS})),
    slots AS (SELECT row_number, x AS slot FROM {rounds_name} WHERE done)"""


def with_row_numbers(df: DataFrame, order: list[str], number: str, partitions: int) -> tuple[DataFrame, int]:
    """Adds gapless row numbers from 0 in ``order`` (nulls first), and says how many rows there are.

    A range sort is written to the shared folder, so that both later passes see the same partitions. The first counts
    rows by partition, which gives one number for each; the second adds the rows before a partition to a row's place
    in it. Rows that ``order`` can't tell apart are numbered in any order.
    """
    place, part, before = f"_{number}_place", f"_{number}_part", f"_{number}_before"
    ordered = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    placed = F.monotonically_increasing_id()
    kept = stored(ordered.withColumns({part: F.shiftright(placed, 33).cast("int"), place: placed.bitwiseAND(F.lit(LOW_BITS_OF_ID))}), "numbered")
    sizes = {r[0]: r[1] for r in kept.groupBy(part).count().collect()}  # a number for each of the partitions chosen above
    total, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    starts_table = df.sparkSession.createDataFrame(starts, f"{part} int, {before} long")
    numbered = kept.join(F.broadcast(starts_table), part).withColumn(number, F.col(before) + F.col(place))
    return numbered.drop(part, place, before), total
