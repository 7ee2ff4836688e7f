"""Part of brinework."""
