"""Operators that prepare corpora for training; nothing outside this folder imports it."""
