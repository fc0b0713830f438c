"""Operators on whole tables; importing this registers their queries."""

from . import access, answers, claims, console, documents, economics, engagement, golden, protection, quality, retrieval, streams, texts, upkeep, uploads, viewer  # noqa: F401
