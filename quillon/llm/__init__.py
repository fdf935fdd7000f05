"""Operators for building training corpora. Nothing else in quillon imports this package."""
