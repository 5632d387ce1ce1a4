"""DataFrame operators over the stored tables."""
