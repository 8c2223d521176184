"""Whole studies composed of the operators."""
