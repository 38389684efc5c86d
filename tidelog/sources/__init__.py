"""Where the log is kept, and logs derived from other tables."""
