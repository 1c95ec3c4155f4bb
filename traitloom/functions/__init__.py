"""Column functions: tokens, texts, web pages and dates."""
