"""Spark-native analytics over pages, glyphs, cells, tables and their evaluation."""
