"""Tidemark: a PySpark engine for data-estate lineage, migration assurance and warehouse analytics."""
