"""Registered queries: each runs an operator over whole driver tables, with the equivalent SQL where SQL can say it."""
