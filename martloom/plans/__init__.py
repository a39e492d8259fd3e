"""Whole-warehouse jobs composed from the operators."""
