"""DataFrame-to-DataFrame operators, grouped by the stage of the workflow."""
