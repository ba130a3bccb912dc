"""Training-data operators: thirteen corpus-scale operators and their query modules.

Nothing else in the library imports this subpackage.
"""
