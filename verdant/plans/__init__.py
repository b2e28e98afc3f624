"""verdant.plans."""
