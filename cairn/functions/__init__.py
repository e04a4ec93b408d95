"""Column-building functions: text keys, angles, dates, ellipsoid and projection arithmetic."""
