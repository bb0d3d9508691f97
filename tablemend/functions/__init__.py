"""Column functions: name resolution, dates, predicates, draws, row digests."""
