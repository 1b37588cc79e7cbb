"""Names to factories: given at once, by a path that is imported when first asked for, or by an installed entry point."""

from __future__ import annotations

from importlib import import_module
from importlib.metadata import entry_points


class Registry:
    """Case, outer spaces and underscores do not matter. What is there is replaced only if told so; plug-ins never replace."""

    def __init__(self, kind: str, **builtin):
        self.kind, self._plugged = kind, False
        self._found = {self.key(name): item for name, item in builtin.items()}
        self._other: dict[str, str] = {}

    @staticmethod
    def key(name: str) -> str:
        return "-".join(name.strip().lower().split("_"))

    def put(self, name: str, item, override: bool = False) -> None:
        """item: a factory, or ``module:attribute``."""
        if isinstance(item, str) and not all(item.partition(":")):
            raise ValueError(f"{item!r} is not module:attribute")
        if self.key(name) in self._found and not override:
            raise ValueError(f"{self.kind} {name!r} is already there")
        self._found[self.key(name)] = item

    def register(self, name: str, override: bool = False):
        """A decorator."""

        def keep(item):
            self.put(name, item, override)
            return item

        return keep

    def alias(self, other: str, name: str) -> None:
        self._other[self.key(other)] = self.key(name)

    def _plug(self) -> None:
        if not self._plugged:
            self._plugged = True
            plugged = entry_points(group=f"{__package__}.{self.kind}")
            self._found = {self.key(p.name): p.value for p in plugged} | self._found

    def names(self) -> list[str]:
        self._plug()
        return sorted(self._found)

    def __contains__(self, name) -> bool:
        return isinstance(name, str) and self._other.get(self.key(name), self.key(name)) in self.names()

    def get(self, name: str):
        key = self._other.get(self.key(name), self.key(name))
        if key not in self._found and key not in self.names():
            raise KeyError(f"unknown {self.kind} {name!r}; one of {self.names()}")
        item = self._found[key]
        if isinstance(item, str):
            module, _, attribute = item.partition(":")
            item = self._found[key] = getattr(import_module(module), attribute)
        return item

    def build(self, name: str, *args, **options):
        return self.get(name)(*args, **options)
