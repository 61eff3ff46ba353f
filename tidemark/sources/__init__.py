"""Readers of files, tracks, timelines, tables of colours and device reports."""
