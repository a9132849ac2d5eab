"""The metrics (query plans) and their registry."""
