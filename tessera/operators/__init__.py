"""Operators beside the pipeline's own."""
