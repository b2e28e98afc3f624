"""verdant.operators."""
