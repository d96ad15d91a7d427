"""quire subpackage."""
