"""Operators for preparing training data: one module each, none imported by the rest of the library."""
