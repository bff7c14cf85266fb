"""Column builders: text, affixes, similarity metrics and prompts."""
