"""Column expressions: text, tokenizer and vector functions."""
