"""Operators over DataFrames: matching, gates, curation, evaluation, checks and taxonomy."""
