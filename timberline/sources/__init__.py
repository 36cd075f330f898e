"""Feature tables, generators and model storage."""
