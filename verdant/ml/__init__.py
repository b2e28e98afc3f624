"""verdant.ml."""
