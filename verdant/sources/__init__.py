"""verdant.sources."""
