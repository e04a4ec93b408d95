"""Survey-network analytics as Spark jobs over station and observation tables."""

__version__ = "0.1.0"
