"""Training-data operators over documents, pages and conversations. Nothing outside this package imports it."""
