"""Training-data operators: cleaning, formatting, scoring, deduplication, mixing and materialisation.

Nothing else in the library imports this subpackage.
"""
