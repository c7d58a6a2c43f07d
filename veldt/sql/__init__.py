"""The SQL surface: lexer, syntax tree, parser."""
