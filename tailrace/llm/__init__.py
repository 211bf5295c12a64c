"""Operators on the texts themselves: overlap, boilerplate, near copies, leaks, mixing, truncation, splits and consensus."""
