"""Records that arrive in files, merged batch by batch."""
