"""Histogram sort: shards of near equal bytes by exact splitters and one exchange.

The sort key of a row is (hash of its text, hash of its id), both 64 bits wide and
read as unsigned, so equal texts stand side by side. For every shard boundary the
driver looks for a splitter: it counts the exact bytes that lie below candidate
boundaries, ``2 ** BITS`` of them in the interval where the boundary must lie, and
repeats the count inside the one cell that holds it until the bytes below some
candidate are within the tolerance of the boundary's share. Counts are summed on the
executors before they are shuffled and only the cells of open intervals are counted,
so the driver sees at most ``boundaries * 2 ** BITS`` cells a round.

When the splitters stand, rows move once, to fine ranges inside the shards; a slot is
the number of rows in the ranges before plus the row's place in its own range.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arterial.llm.common import checkpointed

#: Bits of the key that a round of probes refines.
BITS = 8
#: Rows that a fine range should hold.
RANGE_ROWS = 200_000

_WORDS = 64 // BITS


def text_bytes(text: str) -> Column:
    """UTF-8 bytes of a text plus 8; 8 for a null text."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)).cast("long")


def _cell(level: int) -> Column:
    """The ``BITS`` bits of the 128-bit key that round ``level`` refines."""
    word = "__h1" if level < _WORDS else "__h2"
    shift = 64 - BITS * (level % _WORDS + 1)
    return F.shiftrightunsigned(F.col(word), shift).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _prefix(level: int) -> Column:
    """The key's bits before round ``level``, as text: '' for the first round."""
    if level == 0:
        return F.lit("")
    parts = [F.hex(F.col("__h1"))] + ([F.hex(F.col("__h2"))] if level > _WORDS else [])
    padded = F.concat(*[F.lpad(p, 16, "0") for p in parts])
    return F.substring(padded, 1, level * BITS // 4)


def find_splitters(keyed: DataFrame, goals: list[float], tolerance: float) -> list[int]:
    """For each goal (bytes below it), a 128-bit key such that the bytes of rows below
    are within ``tolerance`` of it, or as near as keys allow."""
    found: dict[int, int] = {}
    # Boundary -> (key bits so far as hex digits, bytes below that cell).
    open_at = {k: ("", 0) for k in range(len(goals))}
    for level in range(2 * _WORDS):
        if not open_at:
            break
        wanted = sorted({p for p, _ in open_at.values()})
        inside = keyed if level == 0 else keyed.where(_prefix(level).isin(wanted))
        rows = inside.groupBy(_prefix(level).alias("p"), _cell(level).alias("c")).agg(F.sum("size").alias("b")).collect()
        cells: dict[str, list[tuple[int, int]]] = {}
        for r in rows:
            cells.setdefault(r["p"], []).append((r["c"], r["b"]))
        for v in cells.values():
            v.sort()
        still = {}
        for k, (prefix, below) in open_at.items():
            sums = [below]
            for _, b in cells.get(prefix, []):
                sums.append(sums[-1] + b)
            numbers = [c for c, _ in cells.get(prefix, [])]
            at = bisect.bisect_right(sums, goals[k]) - 1  # the cell that holds the goal
            low_gap = goals[k] - sums[at]
            high_gap = sums[at + 1] - goals[k] if at + 1 < len(sums) else float("inf")
            last = level == 2 * _WORDS - 1
            rest = 128 - BITS * (level + 1)
            base = int(prefix, 16) << BITS if prefix else 0
            if at >= len(numbers) or low_gap <= min(tolerance, high_gap) or last and low_gap <= high_gap:
                # Below this cell; behind the last one when the goal is the end.
                c = numbers[at] if at < len(numbers) else (numbers[-1] + 1 if numbers else 0)
                found[k] = (base + c) << rest
            elif high_gap <= tolerance or last:
                found[k] = (base + numbers[at] + 1) << rest
            else:
                digits = BITS // 4
                still[k] = (prefix + f"{numbers[at]:0{digits}X}", sums[at])
        open_at = still
    return [found[k] for k in range(len(goals))]


def _at_least(key: int) -> Column:
    """Whether a row's key is ``key`` or above, unsigned."""
    signed = lambda x: x - (1 << 63)  # noqa: E731  order of unsigned values as signed ones
    if key >> 128:
        return F.lit(False)
    high, low = F.lit(signed(key >> 64)), F.lit(signed(key & ((1 << 64) - 1)))
    return (F.col("__o1") > high) | ((F.col("__o1") == high) & (F.col("__o2") >= low))


def histogram_shards(docs: DataFrame, n_shards: int = 24, tolerance: float = 0.002, key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs`` (``key``, text): key, size, text_crc32, shard, slot.

    Law ``bytes``: shard sizes differ from an even share by ``tolerance`` of it at most,
    or by the largest row where that is more. Rows with equal texts share a shard unless
    a boundary can't be met without parting them; then their ids part them, and only rows
    equal in id and text can't be parted. Null texts count 8 bytes and have a null crc;
    they are a group of equal texts. Slots run from 0 without gaps in the order of the
    key; equal rows take places next to each other. An empty table gives an empty result.
    """
    # A null must not share its hash with the empty text by construction of the key order.
    keyed = docs.select(
        F.col(key).alias(key),
        text_bytes("text").alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.xxhash64(F.col("text").isNull(), "text").alias("__h1"),
        F.xxhash64(F.col(key), F.lit(1)).alias("__h2"),
    )
    keyed = checkpointed(keyed)
    total = keyed.agg(F.sum("size"), F.count(F.lit(1))).first()
    size, n = total[0] or 0, total[1]
    goals = [size * k / n_shards for k in range(1, n_shards)]
    splitters = find_splitters(keyed, goals, tolerance * size / n_shards / 2) if n else [0] * (n_shards - 1)

    top = F.lit(-(1 << 63))
    ordered = keyed.withColumn("__o1", F.col("__h1").bitwiseXOR(top)).withColumn("__o2", F.col("__h2").bitwiseXOR(top))
    shard = sum((_at_least(s).cast("int") for s in splitters), F.lit(0))
    # Fine ranges of a shard: equal steps of the first hash. Their number follows the rows,
    # so the rows of one range fit a task at any size; a group of equal texts is dealt over
    # ranges by the second hash.
    fine = max(0, min(20, (n // n_shards // RANGE_ROWS).bit_length()))
    wide = fine + 6
    part = F.shiftrightunsigned("__h1", 64 - wide) if fine else F.lit(0).cast("long")
    placed = ordered.withColumn("shard", shard.cast("int")).withColumn("__r1", part)
    inner = F.shiftrightunsigned("__h2", 64 - fine) if fine else F.lit(0).cast("long")
    placed = placed.withColumn("__r2", inner)
    counts = placed.groupBy("shard", "__r1", "__r2").agg(F.count(F.lit(1)).alias("rows"))
    # Order inside a shard: range of the text hash, range of the id hash, then both keys.
    before = Window.partitionBy("shard").orderBy("__r1", "__r2").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    place = Window.partitionBy("shard", "__r1", "__r2").orderBy("__o1", "__o2", key)
    numbered = placed.withColumn("__place", F.row_number().over(place) - 1)
    out = numbered.join(F.broadcast(starts), ["shard", "__r1", "__r2"]) if fine == 0 else numbered.join(starts, ["shard", "__r1", "__r2"])
    return out.select(key, "size", "text_crc32", "shard", (F.col("__start") + F.col("__place")).cast("long").alias("slot"))
