"""Column functions: time and money, text, similarity, injection patterns."""
