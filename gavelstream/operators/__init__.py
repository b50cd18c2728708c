"""Relational operators that queries share; all of them are plans over DataFrames, none runs an action."""
