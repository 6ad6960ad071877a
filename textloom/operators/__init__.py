"""Operators over corpora: retrieval, structure extraction, merging, events, rules."""
