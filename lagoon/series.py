"""Fluent operators on one series column: nothing runs until an action.

>>> SeriesFrame(df, "cc", first=-48, delta=1.0).unbias(n=720).demean().taper(max_percentage=0.1).df
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.functions import arrays as A
from lagoon.operators import correlate, detect, matrix, transforms


@dataclass(frozen=True)
class SeriesFrame:
    df: DataFrame
    column: str
    first: float = 0.0  # coordinate of element 0
    delta: float = 1.0
    flags: frozenset = frozenset()

    def _with(self, x: Column, *flags: str) -> SeriesFrame:
        return replace(self, df=self.df.withColumn(self.column, x), flags=self.flags | set(flags))

    @property
    def x(self) -> Column:
        return F.col(self.column)

    def abs(self):
        return self._with(A.absolute(self.x))

    absolute = abs

    def demean(self):
        return self._with(A.demean(self.x))

    def detrend(self):
        return self._with(A.detrend(self.x))

    def norm1d(self):
        return self._with(A.norm1d(self.x))

    def taper(self, **options):
        return self._with(A.taper(self.x, delta=self.delta, **options) if "max_length" in options else A.taper(self.x, **options))

    def unbias(self, n: int, clip: float | None = None):
        """Bias correction of a correlation, once only."""
        if "unbiased" in self.flags:
            return self
        return self._with(A.unbias(self.x, n, round(self.first / self.delta), clip), "unbiased")

    def filter(self, frequency, btype: str, order: int = 2):
        return self._with(transforms.filter(self.x, frequency, btype, self.delta, order))

    def timeshift(self, delay: Column | float):
        return self._with(transforms.timeshift(self.x, delay if isinstance(delay, Column) else F.lit(float(delay)), self.delta))

    def envelope(self):
        return self._with(transforms.envelope(self.x))

    def hilbert(self):
        return self._with(transforms.hilbert(self.x))

    def fft(self):
        return self._with(transforms.fft(self.x))

    def rfft(self):
        return self._with(transforms.rfft(self.x))

    def correlate1d(self, other: str, normalize: bool = True):
        return self._with(correlate.cc(self.x, F.col(other), normalize))

    def correlate2d(self, other: str, shape: tuple[int, int], normalize: bool = True):
        return self._with(correlate.cc2d(self.x, F.col(other), shape, normalize))

    def rms(self, name: str = "rms") -> DataFrame:
        return self.df.withColumn(name, A.rms(self.x))

    def snr(self, signal, noise, name: str = "snr", **options) -> DataFrame:
        return self.df.withColumn(name, detect.snr(self.x, self.first, self.delta, signal, noise, **options))

    def window(self, name: str = "window", **options) -> DataFrame:
        return self.df.withColumn(name, A.window(F.size(self.x), **options))

    def unbias_weights(self, n: int, name: str = "weights", clip: float | None = None) -> DataFrame:
        first = round(self.first / self.delta)
        return self.df.withColumn(name, F.transform(F.sequence(F.lit(0), F.size(self.x) - 1), lambda i: A.weight(i + first, n, clip)))

    def ifft(self):
        """Real series of a ``fft`` column."""
        f = self.df.withColumn("_re", F.col(f"{self.column}.re")).withColumn("_im", F.col(f"{self.column}.im"))
        z = f.withColumn(self.column, transforms.ifft(F.col("_re"), F.col("_im"))).withColumn(self.column, F.col(f"{self.column}.re"))
        return replace(self, df=z.drop("_re", "_im"))

    def irfft(self, n: int):
        f = self.df.withColumn("_re", F.col(f"{self.column}.re")).withColumn("_im", F.col(f"{self.column}.im"))
        return replace(self, df=f.withColumn(self.column, transforms.irfft(F.col("_re"), F.col("_im"), n)).drop("_re", "_im"))

    def _long(self, keys: list[str]) -> DataFrame:
        return correlate.to_long(self.df, keys, self.column, "k", "v")

    def norm2d(self, keys: list[str], within: list[str]) -> DataFrame:
        """Long rows (keys, k, v) over the Frobenius norm of all series of a ``within`` group."""
        return matrix.norm2d(self._long(keys), within, "v")

    def lombscargle(self, keys: list[str], freqs: list[float], **options) -> DataFrame:
        long = self._long(keys).withColumn("t", F.lit(self.first) + F.col("k") * self.delta)
        return transforms.lombscargle(long, keys, "t", "v", freqs, **options)

    def coincidence_trigger(self, element: str, **options) -> DataFrame:
        """Triggers of series whose samples are a value per step, one series an element."""
        return detect.coincidence_trigger(self._long([element]), element, "k", "v", **options)

    def peak_local_max(self, keys: list[str], **options) -> DataFrame:
        """Ranked peaks of rows (keys, freq, series)."""
        return detect.peak_local_max(self.df, keys, value=self.column, **options)

    def tri_mirror(self, keys: list[str], i: str, j: str, odd: bool = False, k: int = 0) -> DataFrame:
        """A scalar column over (i, j) mirrored at the diagonal."""
        return matrix.tri_mirror(self.df, keys, i, j, {self.column: odd}, k)

    def plane_wave_estimate(self, geometry: DataFrame, keys: list[str], envelope: bool = False, *, n_pairs: int | None = None, digits: int | None = None) -> DataFrame:
        """Plane waves from correlations of couples: rows (keys, rx_a, rx_b, correlation). Delays are those
        of the largest absolute value, or of the largest of the ``envelope``; of values equal to ``digits``
        decimals the first. With ``n_pairs`` only keys that have so many delays are fitted."""
        x = self.df.withColumn("_x", transforms.envelope(self.x) if envelope else A.absolute(self.x))
        tau = x.select(*keys, "rx_a", "rx_b", correlate.shift(F.col("_x"), self.delta, digits).cast("double").alias("tau"))
        return matrix.plane_wave(tau.join(geometry, ["rx_a", "rx_b"]), keys, n_pairs=n_pairs)

    def spectrogram(self, keys: list[str], duration: float, **options) -> DataFrame:
        return transforms.spectrogram(self.df, keys, self.column, self.delta, duration, **options)

    def cwt(self, keys: list[str], **options) -> DataFrame:
        return transforms.cwt(self.df, keys, self.column, self.delta, **options)

    def scaleogram(self, keys: list[str], **options) -> DataFrame:
        return transforms.scaleogram(self.df, keys, self.column, self.delta, **options)
