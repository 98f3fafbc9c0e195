"""Operators for corpora that train language models. Nothing outside imports this package."""
