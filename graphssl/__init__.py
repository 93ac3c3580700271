"""graphssl: graph-based semi-supervised classification as Spark DataFrame jobs."""

__all__ = ["session", "operators", "sources", "functions", "plans", "streaming"]
