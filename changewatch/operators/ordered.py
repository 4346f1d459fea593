"""Ordered scans per key that stay parallel when one key is very large.

A window puts all rows of a key into one task. Here a key with millions of rows is
first cut into blocks of consecutive rows, each its own window partition, and
what a block needs from the rows before it is carried in from a small table with
one row per block. Keys of ordinary size are one block and pay nothing for it.

Cut points come from the data: a row starts a block if the hash of its key and
position is a multiple of ``every``. So they are the same however often a lost
task is run again, need no sampling, and make blocks of ``every`` rows on average.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVERY = 1_000_000


def cut_points(df: DataFrame, keys: list[str], at: str, every: int = EVERY) -> DataFrame:
    """Sorted block starts of each large key.

    Keys with fewer than two cuts are left out: they are small, or hit by chance.
    """
    chosen = df.select(*keys, at).filter(F.pmod(F.xxhash64(*keys, at), F.lit(every)) == 0)
    cuts = chosen.groupBy(*keys).agg(F.array_sort(F.collect_set(at)).alias("_cuts"))
    return cuts.filter(F.size("_cuts") >= 2)


def _cuts_up_to(cuts: Column, at: Column) -> Column:
    """How many sorted cuts are <= ``at``: a binary search in 32 steps."""

    def step(acc: Column, _: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        return (
            F.when(lo >= hi, acc)
            .when(F.get(cuts, mid) <= at, F.struct((mid + 1).alias("lo"), hi.alias("hi")))
            .otherwise(F.struct(lo.alias("lo"), mid.alias("hi")))
        )

    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, step, lambda acc: acc["lo"])


class Scan:
    """Rows of ``df`` in the order of ``at`` (bigint, unique per key) within ``keys``.

    Building it runs one job over the key and order columns to see whether any key
    needs cutting. ``df`` should therefore be a read table, not a long lineage.
    """

    def __init__(self, df: DataFrame, keys: list[str], at: str, every: int = EVERY):
        self.keys, self.at = keys, at
        cuts = cut_points(df, keys, at, every)
        self.hot = not cuts.isEmpty()
        if self.hot:
            # a left join that AQE may broadcast, or split on its large side
            df = (
                df.join(cuts, keys, "left")
                .withColumn("_hot", F.col("_cuts").isNotNull())
                .withColumn(
                    "_block",
                    F.when(F.col("_hot"), _cuts_up_to(F.col("_cuts"), F.col(at))).otherwise(0),
                )
                .drop("_cuts")
            )
        self.df = df
        self.group = [*keys, "_block"] if self.hot else keys
        self.window = Window.partitionBy(*self.group).orderBy(at)

    def _blocks(self, df: DataFrame, *ends: Column) -> DataFrame:
        return df.filter("_hot").groupBy(*self.group).agg(*ends)

    def _block_window(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy("_block")

    def rank(self, df: DataFrame, name: str) -> DataFrame:
        """1-based place of each row within its key."""
        out = df.withColumn(name, F.row_number().over(self.window).cast("bigint"))
        if not self.hot:
            return out
        before = self._block_window().rowsBetween(Window.unboundedPreceding, -1)
        sizes = self._blocks(df, F.count(F.lit(1)).alias("_n"))
        carry = sizes.withColumn("_before", F.sum("_n").over(before)).drop("_n")
        return (
            out.join(carry, self.group, "left")
            .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
            .drop("_before")
        )

    def previous(self, df: DataFrame, columns: list[str], name: str) -> DataFrame:
        """``name``: the row before, as a struct of ``columns``; NULL for the first."""
        out = df.withColumn(name, F.lag(F.struct(*columns)).over(self.window))
        if not self.hot:
            return out
        ends = self._blocks(df, F.max_by(F.struct(*columns), self.at).alias("_end"))
        carry = ends.withColumn("_carry", F.lag("_end").over(self._block_window())).drop("_end")
        return (
            out.join(carry, self.group, "left")
            .withColumn(name, F.coalesce(name, "_carry"))
            .drop("_carry")
        )

    def latest(self, df: DataFrame, values: dict[str, Column]) -> DataFrame:
        """Each column: its last non-NULL value up to and including the row."""
        upto = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = df.withColumns({n: F.last(v, ignorenulls=True).over(upto) for n, v in values.items()})
        if not self.hot:
            return out
        ends = self._blocks(
            df,
            *(
                F.max_by(v, F.when(v.isNotNull(), F.col(self.at))).alias(f"_end_{n}")
                for n, v in values.items()
            ),
        )
        before = self._block_window().rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.select(
            *self.group,
            *(F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_carry_{n}") for n in values),
        )
        return (
            out.join(carry, self.group, "left")
            .withColumns({n: F.coalesce(n, f"_carry_{n}") for n in values})
            .drop(*(f"_carry_{n}" for n in values))
        )

    def is_last(self, df: DataFrame, name: str) -> DataFrame:
        """Whether the row is the last of its key."""
        out = df.withColumn(name, F.lead(self.at).over(self.window).isNull())
        if not self.hot:
            return out
        blocks = self._blocks(df, F.lit(1).alias("_one"))
        carry = blocks.select(
            *self.group, F.lead("_block").over(self._block_window()).isNotNull().alias("_more")
        )
        return (
            out.join(carry, self.group, "left")
            .withColumn(name, F.col(name) & ~F.coalesce("_more", F.lit(False)))
            .drop("_more")
        )

    def done(self, df: DataFrame) -> DataFrame:
        return df.drop("_hot", "_block")


def ranked(
    df: DataFrame, keys: list[str], at: str, name: str = "rank", every: int = EVERY
) -> DataFrame:
    """``df`` with the 1-based place of each row within ``keys`` by ``at``."""
    scan = Scan(df, keys, at, every)
    return scan.done(scan.rank(scan.df, name))
