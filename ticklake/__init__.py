"""Market-microstructure analytics as Spark plans."""
