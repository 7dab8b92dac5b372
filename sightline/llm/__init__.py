"""Training-data operators: ten jobs over tables of documents, benchmark items and conversations."""
