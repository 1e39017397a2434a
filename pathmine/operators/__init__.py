"""DataFrame operators (graph traversal, dataset layer, vocabularies, repositories)."""
