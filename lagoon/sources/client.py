"""A chain of waveform sources and the checks that a correlation run makes of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.functions import names, times
from lagoon.sources import operations, waveforms


@dataclass
class WaveformSource:
    """Trace tables in order of priority (archive first); the first that is complete is taken.

    ``max_gap`` seconds may be missing from a window; ``force_write`` archives incomplete days too.
    """

    tables: list[DataFrame]
    archive_path: str | None = None
    max_gap: float = 300.0
    force_write: bool = False
    operations: dict[str, list] = field(default_factory=dict)  # of operations on streams, by channel

    def __str__(self) -> str:
        return f"WaveformSource({len(self.tables)} tables, archive={self.archive_path}, max_gap={self.max_gap})"

    def window(self, receiver: str, start: Column, stop: Column, buffer: float = 0.05) -> DataFrame:
        """Traces of a window widened by ``buffer``, from the first source complete for the receiver.
        ``receiver`` may hold ``%``."""
        parts = [waveforms.get_waveforms(t, receiver, start, stop, buffer) for t in self.tables]
        least = times.seconds(start, stop) - self.max_gap
        found = []
        for p in parts:
            seconds = waveforms.duration(p).select(F.col("receiver").alias("_r"), F.col("seconds").alias("_s"))
            found.append(p.join(seconds, F.col("receiver") == F.col("_r"), "left").drop("_r"))
        return waveforms.waterfall(found, ["receiver"], F.col("_s") >= least).drop("_s")

    def processed(
        self, receiver: str, start: Column, stop: Column, rate: float, buffer: float = 0.05, strict: bool = False, inventory: DataFrame | None = None, substitute: bool = True,
    ) -> DataFrame:
        """Windows after the operations of their channel, at the expected sampling rate only and no
        shorter than the window (by two samples at most where not strict).

        Channels pass their recipes as in ``operations.process_channels``: gaps that ``max_gap`` lets in are
        closed, and a receiver whose channel ends in R or T is made of its station's components.
        """
        turned = substitute and receiver[-1] in "RT"
        rows = self.window(receiver[:-1] + "_" if turned else receiver, start, stop, buffer).drop("source")
        done = operations.process_channels(rows, self.operations, starttime=start, endtime=stop, inventory=inventory, substitute=substitute)
        short = times.seconds(start, stop) / F.col("delta") - F.col("npts")
        return done.where(F.col("receiver").like(receiver) & (F.abs(F.col("delta") * rate - 1) < 1e-9) & (short <= (0 if strict else 2)))

    def pair(self, name: str, start: Column, stop: Column, rate: float, **options) -> DataFrame:
        """One row (pair, xa, xb) where both receivers of ``A-B`` have a window."""
        a, b = name.split("-")
        one = lambda r, x: self.processed(r, start, stop, rate, **options).where(F.col("receiver") == r).select(F.lit(name).alias("pair"), F.col("data").alias(x))
        return one(a, "xa").join(one(b, "xb"), "pair")

    def write_back(self, receiver: str, start: Column, stop: Column) -> None:
        """Archives the day slices of a window that a later source than the archive gave."""
        self.store(self.window(receiver, start, stop, 0.0).where("source > 0").drop("source"))

    def store(self, traces: DataFrame, seconds: float = 86400.0) -> None:
        """Archives day slices; of incomplete days only where forced."""
        if self.archive_path is None:
            raise ValueError("no archive to write to")
        waveforms.archive(traces, self.archive_path, 3600.0 if self.force_write else seconds - self.max_gap)

    def verify(self, receivers: DataFrame, first: str, last: str) -> DataFrame:
        """(receiver, day, status): 1 complete, 0 in part, -1 absent, over the first source that has it."""
        days = None
        for i, t in enumerate(self.tables):
            d = waveforms.slice_days(t, 0.0).groupBy("receiver", "day").agg(F.sum(F.col("npts") * F.col("delta")).alias("s")).withColumn("i", F.lit(i))
            days = d if days is None else days.unionByName(d)
        best = days.groupBy("receiver", "day").agg(F.max("s").alias("s"))
        grid = receivers.select("receiver").distinct().select("receiver", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
        j = grid.join(best, ["receiver", "day"], "left")
        return j.select("receiver", "day", F.when(F.col("s") >= 86400 - self.max_gap, 1).when(F.col("s") > 0, 0).otherwise(-1).alias("status"))

    def verify_processing(self, receivers: list[str], start: Column, stop: Column, rate: float) -> dict[str, int]:
        """A dry run of the operations on one window, for all receivers at once: receiver -> 1 good, 0 no
        data, -1 rejected."""
        names_of = lambda df: {r.receiver for r in df.where(F.col("receiver").isin(receivers)).select("receiver").distinct().collect()}  # an array's receivers
        there, good = names_of(self.window("%", start, stop)), names_of(self.processed("%", start, stop, rate))
        return {r: 1 if r in good else -1 if r in there else 0 for r in receivers}


def discover_pairs(tables: DataFrame, pattern: str, channel: str | None = None) -> DataFrame:
    """Distinct pairs whose name matches a LIKE pattern, with both receivers on a channel if given."""
    p = tables.select("pair").distinct().where(F.col("pair").like(pattern))
    if channel is None:
        return p
    ends = F.transform(names.split_pair(F.col("pair")), names.channel)
    return p.where(F.forall(ends, lambda c: c == channel))


def inventory_of(pairs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Inventory rows of the receivers in ``pairs``; a rotated or digit channel takes its station's
    three components."""
    stem = lambda r: F.concat(F.substring(r, 1, F.length(r) - 1), F.lit("_"))
    r = F.col("r")
    wanted = pairs.select(F.explode(names.split_pair(F.col("pair"))).alias("r")).select(F.when(r.rlike("[123NEZRT]$"), stem(r)).otherwise(r).alias("_p")).distinct()
    # an inventory row answers to its own name and to its stem: an equi-join on either
    keyed = inventory.withColumn("_k", F.explode(F.array("receiver", stem(F.col("receiver")))))
    return keyed.join(wanted, F.col("_k") == F.col("_p"), "left_semi").drop("_k").dropDuplicates(["receiver"])
