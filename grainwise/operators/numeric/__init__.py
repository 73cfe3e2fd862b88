"""Models over relations: clusters, regressions and bootstrap intervals, with the rows' keys kept."""
