"""The path query language: its words, its syntax tree, its parser."""
