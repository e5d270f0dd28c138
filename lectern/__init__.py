"""A DataFrame-native engine for page collections: cleaning, chunking, retrieval, evaluation."""
