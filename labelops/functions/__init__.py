"""Column expressions: cleaning, label arrays and scores."""
