"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` holds the thin queries that apply them to whole tables.
"""
