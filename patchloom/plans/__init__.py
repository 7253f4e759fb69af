"""Named queries, their SQL, and whole runs."""
