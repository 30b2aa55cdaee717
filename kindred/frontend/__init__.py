"""Language front-ends: source text in, code units with normalized trees out."""
