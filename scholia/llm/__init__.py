"""Operators for building large text corpora for language-model training."""
