"""Operators of a large-scale training-data pipeline over documents, vectors and web pages.

Nothing else in the library imports this subpackage; its queries are registered
by ``loanlens.llm.queries``."""
