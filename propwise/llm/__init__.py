"""Training-data operators: each module is one operator over a documents, pages or vectors table."""
