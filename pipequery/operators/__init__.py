"""Relational operators that plain SQL has no efficient form of."""
