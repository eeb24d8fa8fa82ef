"""Grids that grow: layer sums and convergence rows from streams of measurements."""
