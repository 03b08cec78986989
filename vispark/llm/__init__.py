"""Operators for preparing large training corpora.  Nothing else in vispark imports this package."""
