"""Operators: matching, inventories, diffs, constraints, reconciliation, graphs, generation."""
