"""verdant.streaming."""
