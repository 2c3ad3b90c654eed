"""Operators that prepare text corpora for training; nothing else in gridloom imports this subpackage."""
