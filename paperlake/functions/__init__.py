"""Functions on LaTeX text: lexing helpers, symbols, and native column expressions."""
