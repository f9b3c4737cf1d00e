"""What a job needs to know about a table."""

from dataclasses import dataclass


@dataclass(frozen=True)
class People:
    """Columns by role, and the promises of a release: groups of at least ``k`` rows with at least ``e`` sensitive values."""

    key: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    sensitive: str
    k: int = 8
    e: int = 3

    @property
    def identifiers(self) -> tuple[str, ...]:
        return self.numeric + self.categorical
