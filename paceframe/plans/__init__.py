"""User-facing jobs built from the operators."""
