"""Table-generating operators: documents in, relations of tokens, events, grammar units and nodes out."""
