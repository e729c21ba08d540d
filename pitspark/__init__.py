"""pitspark: point-in-time market research and strategy falsification on Spark."""
