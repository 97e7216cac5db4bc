"""Column-level building blocks: every function maps Column -> Column."""
