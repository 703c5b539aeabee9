"""Column functions: text, URLs, contacts and log records."""
