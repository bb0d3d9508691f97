"""DataFrame operators: inject, profile, compare keys, repair, correct, report."""
