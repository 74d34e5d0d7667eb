"""Column helpers, ordering and lineage helpers shared by the operators."""
