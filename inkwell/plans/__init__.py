"""Queries over the derived inputs, each with the SQL that says the same."""
