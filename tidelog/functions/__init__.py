"""Column functions of the log store: text, time, vectors, bloom filters, JSON, embedders and summarizers."""
