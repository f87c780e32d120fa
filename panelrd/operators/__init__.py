"""DataFrame → DataFrame operators (collapse, reshape, summaries, cutoffs,
bins, OLS, regression discontinuity, density test)."""
