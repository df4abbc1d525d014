"""Plan-level helpers: monoids, session modes, prepared programs."""
