"""Part of gridtrace; see README.md."""
