"""Operators over documents, chunks, vectors, queries and ranked lists."""
