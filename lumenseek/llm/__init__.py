"""Training-data operators: building blocks for corpus preparation.

Nothing else in the library imports this subpackage.
"""
