"""Column expressions: encoders, composite features, blends and decision rules."""
