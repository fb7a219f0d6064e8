"""Writers: exports, snapshots, append-only tables."""
