"""Quillmark: text-corpus curation, retrieval, record repair and paired evaluation on PySpark."""
