"""Sources: workspaces, notes, patches, precise indexes, symbol extraction."""
