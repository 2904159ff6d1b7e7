"""Headings in plain Python, for readers that build Markdown line by line."""

from __future__ import annotations

import re

from pactum.functions.patterns import NUMBER_PREFIX

_NUMBER = re.compile(NUMBER_PREFIX.removeprefix("(?Udiu)"), re.IGNORECASE)


def strip_number(title: str) -> str:
    return _NUMBER.sub("", title, count=1).strip()


def heading_like(title: str) -> bool:
    """Short, and of few words."""
    t = title.strip().rstrip(".:;,")
    return 2 <= len(t) <= 90 and len(t.split()) <= 10
