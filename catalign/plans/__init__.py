"""End-to-end jobs that chain operators over stage tables."""
