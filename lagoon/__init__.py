"""lagoon: windowed cross-correlation analytics for labelled time series on Spark."""

__version__ = "0.1.0"
