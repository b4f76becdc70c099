"""Plan helpers that several operators share."""
