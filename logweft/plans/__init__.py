"""Named queries over the shared tables."""
