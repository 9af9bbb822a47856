"""Operators for training-data pipelines: documents in, decisions, scores, spans and files out. Nothing else in the library imports this folder."""
