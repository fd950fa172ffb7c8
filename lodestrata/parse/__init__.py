"""Symbols, calls and imports of source code, without a grammar library.

Python is parsed by `ast`, and by indentation where that fails. Other languages are
scanned: comments and strings are blanked, declarations found by their forms, and their
ends by braces, `end` words or lines. All offsets are bytes.
"""
