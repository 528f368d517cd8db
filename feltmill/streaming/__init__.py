"""Structured Streaming intake on top of the batch operators."""
