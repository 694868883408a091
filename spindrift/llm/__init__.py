"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage.  ``catalog`` holds the
registered queries and their SQL; each other module is one operator.
"""
