"""Operators for building training corpora: filters, deduplication, encoding, packing.

Nothing else in the library imports this subpackage. Each operator reads a table with
``doc_id`` and ``text`` (other columns are ignored or handed through) and is described
in its own module; :mod:`pairlens.llm.queries` binds them to the ``documents`` table.
"""
