"""Operators for preparing training text: pair joins, classifiers, extraction, mixing."""
