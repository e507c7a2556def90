"""Subpackage of lynceus; see the README for its contents."""
