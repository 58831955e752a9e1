"""Prompt and message templates as data: checked, rendered by column functions, kept as JSON.

A template has named places in braces, ``{name}``; doubled braces are literal.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACE = re.compile(r"(?<!\{)\{([A-Za-z_]\w*)\}(?!\})")
#: Characters from which a rendered text is reported as long.
LONG = 8_000


@dataclass
class Template:
    name: str
    text: str
    required: tuple[str, ...] = ()

    @property
    def places(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(_PLACE.findall(self.text)))


@dataclass
class Templates:
    """Templates by name, with the operations of a registry."""

    items: dict[str, Template] = field(default_factory=dict)

    def add(self, template: Template) -> None:
        problems = self.problems(template)
        if problems:
            raise ValueError("; ".join(problems))
        self.items[template.name] = template

    def update(self, name: str, text: str, required: tuple[str, ...] | None = None) -> None:
        """Replaces the text of a known template; a text that breaks it is refused and changes nothing."""
        old = self.items[name]
        self.add(Template(name, text, old.required if required is None else required))

    @staticmethod
    def problems(template: Template) -> list[str]:
        out = []
        if not template.name.strip():
            out.append("the template has no name")
        if not template.text.strip():
            out.append("the template is empty")
        out += [f"required place {r!r} is not in the text" for r in template.required if r not in template.places]
        bare = re.sub(r"\{\{|\}\}", "", _PLACE.sub("", template.text))
        if "{" in bare or "}" in bare:
            out.append("a brace is neither doubled nor part of a place")
        return out

    def render(self, name: str, **values: str) -> str:
        template = self.items[name]
        missing = [p for p in template.places if p not in values]
        if missing:
            raise KeyError(f"missing values: {', '.join(missing)}")
        return _PLACE.sub(lambda m: str(values[m[1]]), template.text).replace("{{", "{").replace("}}", "}")

    def to_json(self) -> str:
        return json.dumps([asdict(t) for t in self.items.values()], ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Templates:
        out = cls()
        for item in json.loads(text):
            out.add(Template(item["name"], item["text"], tuple(item["required"])))
        return out

    def statistics(self) -> dict[str, int]:
        return {"n_templates": len(self.items), "n_places": sum(len(t.places) for t in self.items.values()), "longest": max((len(t.text) for t in self.items.values()), default=0)}


def rendered(template: Template, **values: Column) -> Column:
    """struct(text, missing, long) of each row: the template filled in from columns.

    A place whose column is absent or null is listed in ``missing``, and the text is then null.
    """
    pieces, at = [], 0
    for m in _PLACE.finditer(template.text):
        pieces += [F.lit(template.text[at : m.start()].replace("{{", "{").replace("}}", "}")), values.get(m[1], F.lit(None)).cast("string")]
        at = m.end()
    pieces.append(F.lit(template.text[at:].replace("{{", "{").replace("}}", "}")))
    missing = F.filter(F.array(*[F.when(values.get(p, F.lit(None)).isNull(), F.lit(p)) for p in template.places] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    text = F.concat(*pieces)
    return F.struct(text.alias("text"), missing.alias("missing"), (F.length(text) > LONG).alias("long"))
