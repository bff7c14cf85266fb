"""Whole flows: the batch pipeline, the facade and external scorers."""
