"""All registered queries and their DuckDB counterparts."""

from __future__ import annotations

from studyloom.plans import alignment, answers, documents, events, graphs, identity, imports, learning, packing, relational, review, rows, structure

BOOKS = (documents.BOOK, events.BOOK, learning.BOOK, relational.BOOK, review.BOOK, identity.BOOK, packing.BOOK, structure.BOOK, rows.BOOK, graphs.BOOK, imports.BOOK, alignment.BOOK, answers.BOOK)
QUERIES = {name: f for book in BOOKS for name, f in book.queries.items()}
ORACLES = {name: sql for book in BOOKS for name, sql in book.oracles.items()}
FLAGSHIP = "near_duplicate_report"
