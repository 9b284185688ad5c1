"""Tables: catalogs, snapshots, schemas."""
