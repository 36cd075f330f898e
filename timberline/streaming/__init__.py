"""Forests over micro-batches."""
