"""Writers for reports, metrics and fitted bundles."""
