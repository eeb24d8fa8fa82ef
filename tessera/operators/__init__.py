"""DataFrame-to-DataFrame operators. Grids are long tables keyed by integer cell numbers; coordinates are derived."""
