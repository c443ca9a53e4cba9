"""Column-level building blocks: bands, tiers, rates, scaling."""
