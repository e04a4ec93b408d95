"""Plan-shaping helpers: lineage cuts, ordered scans without one-task windows, skew handling."""
