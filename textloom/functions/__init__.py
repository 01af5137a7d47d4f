"""Column functions: text, classification, titles, questions, vectors."""
