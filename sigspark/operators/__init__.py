"""Operators on long tables of series: ``f(df, ..., keys=..., ...) -> DataFrame``, lazy and without collecting."""
