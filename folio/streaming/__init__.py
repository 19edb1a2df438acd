"""Streams of documents. Operators on single documents are stateless, so their expressions run on streams as they are."""
