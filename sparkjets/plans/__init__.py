"""Composed jobs: flatten + resample, training table, evaluation."""
