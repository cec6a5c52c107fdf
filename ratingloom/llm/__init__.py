"""Operators that prepare text corpora for training: filtering, de-duplication, mixing, tokens, files."""
