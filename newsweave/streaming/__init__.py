"""Jobs on arriving data."""
