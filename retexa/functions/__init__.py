"""Column builders for words, n-grams, windows and vectors."""
