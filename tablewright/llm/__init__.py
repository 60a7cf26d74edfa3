"""Operators over text corpora, embeddings, pages and conversations."""
