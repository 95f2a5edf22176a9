"""Part of graftline; see the README."""
