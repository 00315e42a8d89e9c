"""inkgauge: DataFrame and Structured Streaming operators for text provenance
features, model scoring and request telemetry on Spark."""

__version__ = "0.1.0"
