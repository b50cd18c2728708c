"""Scalar functions and aggregates that Spark lacks under one name, made of built-in ones."""
