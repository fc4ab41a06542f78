"""Crawl-data analytics on Spark: URL algebra, frontier, dedup, extraction, statistics and sinks as DataFrame plans."""
