"""Whole computations built from the operators."""
