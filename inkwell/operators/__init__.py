"""Operators over pixels, boxes, predictions, samples and reports."""
