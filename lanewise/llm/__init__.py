"""Operators of a training-data pipeline over the tables documents, embeddings, pages and benchmark."""
