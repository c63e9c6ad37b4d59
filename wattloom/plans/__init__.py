"""Whole jobs: labels, encoder, training rows, model, evaluation, scoring."""
