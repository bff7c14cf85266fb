"""Text-quality analytics on Spark: matching, scoring, gating, curation and evaluation of paired texts."""

__version__ = "0.1.0"
