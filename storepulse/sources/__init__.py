"""Sources: table scans, file and stream readers, and feeds derived from the driver tables."""
