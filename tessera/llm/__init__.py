"""Training-data operators over text tables; nothing else in the library imports this subpackage."""
