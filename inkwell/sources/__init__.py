"""Readers and writers: labels, class maps, folders, images and reports."""
