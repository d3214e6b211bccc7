"""Plans: the index of a workspace, fact memory, and the tools that compose the operators."""
