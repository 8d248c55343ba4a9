"""Operators for preparing training corpora; nothing else in docloom imports this subpackage."""
