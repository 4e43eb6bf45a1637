"""What a file has at a path that is no dataset."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Node:
    """A group."""

    attrs: dict
