"""File sources, lineage, ingestion and snapshots."""
