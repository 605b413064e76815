"""Relational operators as thin functions over DataFrames; Catalyst plans them."""
