"""functions of the key-value log engine."""
