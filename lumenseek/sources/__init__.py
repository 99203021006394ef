"""Files, stored tables and settings."""
