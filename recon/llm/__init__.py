"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this subpackage. Each module holds one operator with an interface
of its own; ``queries`` binds them to the tables of a folder.
"""
