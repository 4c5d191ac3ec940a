"""Training-data operators over a documents table; see ``queries`` for the registered ones."""
