"""Training-data operators: ten jobs over documents, pages and embeddings, and the queries that apply them."""
