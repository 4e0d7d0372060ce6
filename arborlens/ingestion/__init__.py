"""From a repository's files to a property graph: structure, definitions, imports, calls."""
