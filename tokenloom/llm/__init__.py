"""Operators for preparing training text: near copies, fingerprints, classifiers, extraction, archives, scoring."""
