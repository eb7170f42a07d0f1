"""Whole queries made of operators: check, diff, generate; and the registered queries."""
