"""Change intelligence on Spark: what changed, what it reaches, and where the answer is blind."""

__version__ = "0.1.0"
