"""Scopes of block graphs (JN-1..6).

A *scope* is the set of key columns inside which ids resolve: the document
(``["doc_id"]``) or one page of it (``["doc_id", "page"]``).  Ids never
resolve across scopes (JN-4).  The lookups are in ``operators/batches.py``.
"""

from __future__ import annotations

DOC = ["doc_id"]
PAGE = ["doc_id", "page"]


def scope_cols(scope: str) -> list[str]:
    if scope == "document":
        return DOC
    if scope == "page":
        return PAGE
    raise ValueError(f"unknown scope {scope!r}")
