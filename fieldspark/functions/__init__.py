"""Column -> Column rules."""
