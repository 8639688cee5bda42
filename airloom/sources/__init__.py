"""Table scans, nested payload readers, catalogues, snapshots and manifests."""
