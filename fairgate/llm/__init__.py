"""Operators for preparing training text: each module holds one operator
with its general interface; ``queries`` registers the contract queries.
Nothing outside this subpackage imports it."""
