"""Readers and writers for corpora, predictions and logs."""
