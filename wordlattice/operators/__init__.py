"""Segmentation, rendering, evaluation and corpus preparation."""
