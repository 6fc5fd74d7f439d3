"""Writers and table changes."""
