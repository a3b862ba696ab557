"""Log folders followed as they grow."""
