"""Part of newsloom."""
