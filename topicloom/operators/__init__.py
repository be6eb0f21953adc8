"""Relational operators: vocabulary, bag of words, batches, EM steps, reports."""
