"""What a Python worker holds between tasks.

Workers are used again, also by the next operators' tasks: a memo that one operator keeps for its own later tasks would take memory
from all that follow. An operator that begins a task makes room: what others hold goes.
"""

from __future__ import annotations

from collections.abc import Callable

_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, forget: Callable[[], None]) -> None:
    """``forget`` drops what the operator keeps in this worker."""
    _held[owner] = forget


def make_room(owner: str) -> None:
    for other in [o for o in _held if o != owner]:
        _held.pop(other)()
