"""Named spaces and schemes: registration at run time, resolution of names, merged definitions, semantic paths and back."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.nested import distinct_list

LISTS = ("entries", "include", "exclude", "compose")
#: Spaces that are rules for others and hold no files of their own.
RULES_ONLY = ("gitignore", "readonly")


@dataclass(frozen=True)
class Space:
    """owner/name; entries are folders, compose names of other spaces (with ! in front: taken out). Owner '' marks a union of a short name."""

    owner: str
    name: str
    entries: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    compose: tuple[str, ...] = ()
    watch: bool = True
    ephemeral: bool = False
    extra: dict = field(default_factory=dict)

    @property
    def full(self) -> str:
        return f"{self.owner}/{self.name}"


def merged_definition(old: dict, new: dict, collapse: bool = True) -> dict:
    """Lists one after the other, each value once; other fields as the later says. An include of '*' takes in all others."""
    out = old | {k: distinct_list(list(old.get(k, [])), list(v)) if k in LISTS else v for k, v in new.items()}
    if collapse and "*" in out.get("include", ()):
        out["include"] = ["*"]
    return out


class Unknown(KeyError):
    """No space of this name."""


class Catalog:
    """Spaces by name. Registered DataFrames are temporary views, so SQL sees them too."""

    def __init__(self):
        self.spaces: dict[str, Space] = {}

    def register(self, space: Space, replace_it: bool = False, rows: DataFrame | None = None) -> Space:
        if space.full in self.spaces and not replace_it:
            raise ValueError(f"{space.full} is registered already")
        self.spaces[space.full] = space
        if rows is not None:
            rows.createOrReplaceTempView(self.view(space.full))
        return space

    def ephemeral(self, name: str, rows: DataFrame | None = None, **more) -> Space:
        """A space for this session, in place of one of the name."""
        return self.register(Space("", name, ephemeral=True, **more), True, rows)

    def unregister(self, name: str, spark=None) -> bool:
        if spark is not None:
            spark.catalog.dropTempView(self.view(name))
        return self.spaces.pop(name, None) is not None

    @staticmethod
    def view(name: str) -> str:
        return "space_" + "".join(c if c.isalnum() else f"_{ord(c):x}_" for c in name)

    def short(self, name: str) -> list[Space]:
        return [s for s in self.spaces.values() if s.owner and s.name == name]

    def resolve(self, query: str | None = None) -> list[Space]:
        """'' the workspace, or else all owners' spaces with files; '*' those that are watched; owner/name or /name just that; a short
        name its union if there is one, else all of the name."""
        q = (query or "").strip()
        live = [s for s in self.spaces.values() if s.owner and s.name not in RULES_ONLY and (s.entries or s.compose)]
        if not q:
            return [self.spaces["/workspace"]] if "/workspace" in self.spaces else live
        if q in ("*", "__all__"):
            return [s for s in live if s.watch]
        if "/" in q:
            found = [self.spaces[q]] if q in self.spaces else []
        else:
            found = [self.spaces[f"/{q}"]] if f"/{q}" in self.spaces else self.short(q)
        if not found:
            raise Unknown(f"no space {q}; there are {', '.join(sorted(self.spaces))}")
        return found

    def unions(self) -> None:
        """A space for each short name that several owners have, composed of theirs."""
        for name in {s.name for s in self.spaces.values() if s.owner}:
            same = self.short(name)
            if len(same) > 1 and f"/{name}" not in self.spaces:
                self.spaces[f"/{name}"] = replace(same[0], owner="", entries=(), compose=tuple(s.full for s in same))

    def parts(self, space: Space, visiting: tuple[str, ...] = ()) -> tuple[list[Space], list[Space]]:
        """(added, taken out): the spaces that a space is composed of in the end. A circle or an unknown name is an error."""
        if space.full in visiting:
            raise ValueError("spaces composed in a circle: " + " > ".join((*visiting, space.full)))
        plus, minus = ([space] if space.entries else []), []
        for name in space.compose:
            for child in self.resolve(name.lstrip("!")):
                added, gone = self.parts(child, (*visiting, space.full))
                (minus if name.startswith("!") else plus).extend(added)
                minus += gone
        return plus, minus

    def dependents(self, name: str) -> list[str]:
        """The spaces to take anew when one changes: its short name's union, all that are composed of it, and the whole."""
        out, queue = [], [name]
        while queue:
            at = queue.pop(0)
            short = at.split("/", 1)[1]
            for s in self.spaces.values():
                uses = any(at == c.lstrip("!") or c.lstrip("!") == short for c in s.compose) or (s.owner == "" and s.name == short and s.full != at)
                if uses and s.full != name and s.full not in out:
                    out.append(s.full)
                    queue.append(s.full)
        return [*out, "__all__"]


def resolve_uri(uri: str, schemes: dict[str, str], visiting: tuple[str, ...] = ()) -> str:
    """scheme://rel as a path. A scheme's base may be of another scheme; circles, unknown schemes and ways out of the base are errors."""
    scheme, sep, rel = uri.partition("://")
    if not sep:
        return posixpath.normpath(uri)
    if scheme in visiting:
        raise ValueError("schemes in a circle: " + " > ".join((*visiting, scheme)))
    if scheme not in schemes:
        raise Unknown(f"no scheme {scheme}")
    base = resolve_uri(schemes[scheme], schemes, (*visiting, scheme))
    path = posixpath.normpath(posixpath.join(base, rel.lstrip("/"))) if rel else base
    if path != base and not path.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"{uri} leads out of its base")
    return path


def to_uri(path: Column, schemes: dict[str, str]) -> Column:
    """The inverse on a column: the scheme with the longest base around a path; null if none is."""
    out = F.lit(None).cast("string")
    bases = sorted(((resolve_uri(f"{s}://", schemes), s) for s in schemes), key=lambda b: (len(b[0]), b[1]))
    for base, scheme in bases:  # the longest is tried first
        inside = F.concat(F.lit(f"{scheme}://"), F.substring(path, len(base.rstrip("/")) + 2, 1_000_000))
        out = F.when(path == base, f"{scheme}://").when(path.startswith(base.rstrip("/") + "/"), inside).otherwise(out)
    return out
