"""Operators for preparing language-model training text at corpus scale.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general interface; ``queries`` binds the operators to the supplied tables.
"""
