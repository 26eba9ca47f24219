"""mailloom: a PySpark-native engine for e-mail corpora (DataFrame in, DataFrame out)."""

__version__ = "0.1.0"
