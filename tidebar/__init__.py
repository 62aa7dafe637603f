"""Market-bar and trade analytics as DataFrame, SQL and Structured Streaming plans."""
