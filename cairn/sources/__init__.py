"""Readers: text, CSV and XML files to station, observation and model tables."""
