"""Operators over documents: each a pure function of one document with an Arrow UDF face, or a DataFrame transform."""
