"""Prompt and response text."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefloom.schemas import EOS_TEXT

# The characters Python's str.strip() removes.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS))


@dataclass(frozen=True)
class Template:
    """A prompt template, read once on the driver: literal texts and field names in turn."""

    parts: tuple[tuple[str, str | None], ...]

    @classmethod
    def parse(cls, template: str) -> Template:
        parts = []
        for literal, field, spec, conversion in Formatter().parse(template):
            if spec or conversion:
                raise ValueError(f"only plain fields are supported, got {field!r} with a format")
            parts.append((literal, field))
        return cls(tuple(parts))

    def render(self, fields: Mapping[str, Column], null_text: str = "None") -> Column:
        pieces: list[Column] = []
        for literal, field in self.parts:
            if literal:
                pieces.append(F.lit(literal))
            if field is not None:
                if field not in fields:
                    raise KeyError(f"the template needs a field {field!r}")
                pieces.append(F.coalesce(fields[field].cast("string"), F.lit(null_text)))
        return F.concat(*pieces) if pieces else F.lit("")

    def around(self, field: str) -> tuple[Template, Template]:
        """The parts before and after the only use of ``field``."""
        spots = [i for i, (_, name) in enumerate(self.parts) if name == field]
        if len(spots) != 1:
            raise ValueError(f"the template must use {field!r} exactly once to cut it")
        spot = spots[0]
        before = (*self.parts[:spot], (self.parts[spot][0], None))
        return Template(before), Template(self.parts[spot + 1 :])


def format_prompt(template: str, fields: Mapping[str, Column], null_text: str = "None") -> Column:
    """Fill a ``{field}`` template; a NULL field reads as ``null_text``."""
    return Template.parse(template).render(fields, null_text)


def format_response(text: Column, leading_blank: bool = False, eos_text: str = EOS_TEXT, null_text: str = "None") -> Column:
    """A response with its end marker; supervised summaries also get a blank in front."""
    body = F.concat(F.coalesce(text, F.lit(null_text)), F.lit(eos_text))
    return F.concat(F.lit(" "), body) if leading_blank else body


def join_query_response(query: Column, response: Column) -> Column:
    return F.concat(strip(query), response)
