"""Column functions: text, URLs, HTTP values, hashes."""
