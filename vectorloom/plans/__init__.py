"""End-to-end run workflows and the registry of checked queries."""
