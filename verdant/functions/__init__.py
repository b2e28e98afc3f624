"""verdant.functions."""
