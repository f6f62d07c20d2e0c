"""Operators over records, images and stages."""
