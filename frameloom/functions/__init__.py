"""Scalar formulas, as SQL expressions that Catalyst compiles."""
