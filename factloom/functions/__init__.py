"""factloom subpackage."""
