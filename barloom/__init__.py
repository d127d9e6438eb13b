"""Spark jobs for market bars: candle ingestion and quality, indicators, regimes, and related table jobs."""
