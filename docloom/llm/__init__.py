"""Training-data operators: ten corpus-scale operators and their registered
queries (``queries.py``).  Nothing else in the library imports this package."""
