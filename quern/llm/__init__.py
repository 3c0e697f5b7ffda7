"""Operators for preparing large text collections for model training.

Nothing outside this subpackage imports it; removing the folder leaves the
rest of the library working.
"""
