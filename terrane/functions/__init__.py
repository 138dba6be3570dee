"""Column expressions over sequences and numbers."""
