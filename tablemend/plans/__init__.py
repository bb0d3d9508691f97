"""Specifications of known datasets and the runs that put the operators together."""
