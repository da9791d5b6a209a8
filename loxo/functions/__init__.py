"""Part of loxo."""
