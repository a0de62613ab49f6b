"""Column functions: text, geography, urls, tags, hours, requests, similarity."""
