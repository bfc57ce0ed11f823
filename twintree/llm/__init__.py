"""Operators for preparing training data; nothing else in twintree imports this subpackage."""
