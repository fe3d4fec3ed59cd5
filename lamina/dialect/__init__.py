"""The query dialect: text to syntax tree."""
