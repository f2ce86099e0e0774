"""quarry: evidence, text and graph analytics as declarative Spark programs."""
