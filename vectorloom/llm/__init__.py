"""Training-data operators over raw text; nothing else in the library imports this subpackage."""
