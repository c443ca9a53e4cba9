"""Named reports: loan-book risk, return panels, models, backtests."""
