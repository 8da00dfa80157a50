"""The queries that the engine is checked and timed with, and their SQL."""
