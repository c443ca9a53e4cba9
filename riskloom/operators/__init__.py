"""Table-level building blocks: ordered windows, ranks, shares, staging."""
