"""Training-data operators: scoring, counting, cleaning, de-duplicating and encoding a corpus.

Nothing else in the library imports this package; it can be deleted as a whole.
"""
