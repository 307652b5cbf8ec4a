"""Syntax checking of source files: lexers, recursive descent with precedence climbing, recovery."""
