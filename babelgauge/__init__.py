"""babelgauge: evaluation analytics for text generation and translation, on Spark DataFrames."""

__version__ = "0.1.0"
