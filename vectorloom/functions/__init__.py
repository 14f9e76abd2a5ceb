"""Column-level helpers (``Column -> Column``) shared by the operators."""
