"""Where files come from: trees with ignore rules, lists of paths, word lists, settings."""
