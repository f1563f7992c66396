"""Operations for large training-text collections, each a Spark job over documents, pages or vectors.

Nothing outside this subpackage imports it; the entry module adds its queries only where it exists.
"""
