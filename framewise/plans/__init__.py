"""Plan helpers: shared folder, lineage cuts, size-checked broadcasts."""
