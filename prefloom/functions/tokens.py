"""Tokenizers: text to token ids, token counts and prompts cut to a budget.

``WordTokenizer`` stays inside the JVM: a token is a run of non-blank characters and its id
comes from its md5, so ids agree on every machine without a vocabulary; ``splitter`` and ``hasher`` are its
forms inside a Python task. ``CallableTokenizer``
wraps any encoder the caller brings (a BPE, say) in Arrow functions. Both share one surface,
so the plans take either.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.functions.sequences import let
from prefloom.functions.text import Template
from prefloom.schemas import EOS_TEXT, PAD_TEXT

# What parts words; a no-break space, say, does not.
WORD_BLANKS = " \t\n\x0b\x0c\r"

# Hexadecimal digits of the md5 that make a word id: 60 bits, which fit a bigint.
ID_DIGITS = 15

IDS = T.ArrayType(T.LongType(), containsNull=False)

# Texts and ids of a batch are worked on in slices of so many bytes, as their lists take many times that.
SLICE_BYTES = 1 << 20


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``most`` at most; a larger row is a range of its own."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, end
        start = end


def text_sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass(frozen=True)
class WordTokenizer:
    pad_id: int = 0
    eos_id: int = 1
    first_word_id: int = 2
    pad_text: str = PAD_TEXT
    eos_text: str = EOS_TEXT

    @property
    def specials(self) -> dict[str, int]:
        return {self.eos_text: self.eos_id, self.pad_text: self.pad_id}

    def _spaced(self, text: Column) -> Column:
        # A special text is a token of its own even where it touches a word.
        for special in self.specials:
            text = F.replace(text, F.lit(special), F.lit(f" {special} "))
        return text

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(self._spaced(text), F.lit(r"\S+"), 0)

    def word_id(self, word: Column) -> Column:
        hashed = F.conv(F.substring(F.md5(word), 1, ID_DIGITS), 16, 10).cast("bigint") + F.lit(self.first_word_id)
        out = F.when(word == self.eos_text, F.lit(self.eos_id).cast("bigint"))
        return out.when(word == self.pad_text, F.lit(self.pad_id).cast("bigint")).otherwise(hashed)

    def encode(self, text: Column, limit: int | None = None) -> Column:
        """Token ids of the whole text, or of its first ``limit`` tokens."""
        words = self.words(text)
        if limit is not None:
            words = F.slice(words, 1, limit)
        return F.transform(words, self.word_id)

    def splitter(self) -> Callable[[bytes], list[bytes]]:
        """``words`` of UTF-8 bytes, which ``bytes.split`` parts at the same six blanks."""
        marks = [s.encode() for s in self.specials]

        def split(text: bytes) -> list[bytes]:
            for mark in marks:
                text = text.replace(mark, b" " + mark + b" ")
            return text.split()

        return split

    def hasher(self) -> Callable[[bytes], int]:
        """``word_id`` of a word's UTF-8 bytes."""
        marks, first, rest = {s.encode(): i for s, i in self.specials.items()}, self.first_word_id, 64 - 4 * ID_DIGITS

        def word_id(word: bytes) -> int:
            own = marks.get(word)
            return own if own is not None else (int.from_bytes(hashlib.md5(word).digest()[:8]) >> rest) + first

        return word_id

    def count(self, text: Column) -> Column:
        return F.regexp_count(self._spaced(text), F.lit(r"\S+"))

    def drop_specials(self, text: Column) -> Column:
        for special in self.specials:
            text = F.replace(text, F.lit(special), F.lit(""))
        return text

    def fit_prompt(
        self,
        template: str,
        fields: Mapping[str, Column],
        budget: int,
        cut_field: str = "post",
        cut_text: str = "\n",
        null_text: str = "None",
    ) -> Column:
        """The rendered prompt, its cut field shortened until the prompt has at most
        ``budget`` tokens: whole lines go first, then characters of the first line. NULL
        when even an empty field leaves too many tokens.

        Blank-separated tokens add up over lines, so the result has a closed form: keep the
        longest prefix of the field with at most ``room`` tokens, and drop its last,
        incomplete line.
        """
        before, after = Template.parse(template).around(cut_field)
        if len(cut_text) != 1 or cut_text not in WORD_BLANKS:
            raise ValueError("word tokens can only be cut at a single blank character")
        head_literal, tail_literal = before.parts[-1][0], after.parts[0][0] if after.parts else ""
        touches_head = head_literal and head_literal[-1] not in WORD_BLANKS
        touches_tail = tail_literal and tail_literal[0] not in WORD_BLANKS
        glued = not head_literal and len(before.parts) > 1 or not tail_literal and len(after.parts) > 0
        if touches_head or touches_tail or glued:
            raise ValueError(f"{cut_field!r} must stand between blanks in the template")
        head, tail = before.render(fields, null_text), after.render(fields, null_text)
        field = F.coalesce(fields[cut_field].cast("string"), F.lit(null_text))
        room = F.lit(budget) - self.count(head) - self.count(tail)

        specials = "|".join(re.escape(s) for s in self.specials)
        starts = "".join(sorted({re.escape(s[0]) for s in self.specials}))
        # Only a character that may start a special text needs a look ahead.
        token = rf"(?:{specials}|(?:[^\s{starts}]++|(?!{specials})[{starts}])++)"
        pattern = F.concat(F.lit(rf"^(\s*+(?:{token}\s*+){{0,"), F.greatest(room, F.lit(0)).cast("string"), F.lit("}+)"))
        kept = F.call_function("regexp_extract", field, pattern, F.lit(1))

        def shorten(kept: Column) -> Column:
            whole = F.char_length(kept) == F.char_length(field)
            last_line = F.substring_index(kept, cut_text, -1)
            whole_lines = F.left(kept, F.char_length(kept) - F.char_length(last_line) - 1)
            cut = F.when(whole, kept).when(F.contains(kept, F.lit(cut_text)), whole_lines)
            rest = F.substr(field, F.char_length(kept) + 1)
            ends_in_word = kept.rlike(rf"\S$") & ~kept.rlike(rf"(?:{specials})$")
            for special in self.specials:
                # Cutting one character off a special text glued to a word melts it into that word.
                cut = cut.when(ends_in_word & F.startswith(rest, F.lit(special)), F.concat(kept, F.lit(special[:-1])))
            return cut.otherwise(kept)

        fitted = F.when(room >= 0, let(kept, shorten))
        return F.concat(head, fitted, tail)


def longest_that_may_fit(field: str, cut_text: str, room: int) -> str:
    """The first of the candidates in cutting order (whole lines off the end, then characters of the first
    line) that has at most ``room`` characters; the empty one if none has."""
    if len(field) <= room:
        return field
    if room < 0:
        return ""
    line = field.rfind(cut_text, 0, room + len(cut_text))
    return field[:line] if line >= 0 else field[:room]


@dataclass(frozen=True)
class CallableTokenizer:
    """A tokenizer the caller brings. ``make_encoder()`` is called once per task and returns
    ``encode(text) -> list[int]``; it must know the special texts itself. ``longest_token`` is how many
    characters one token covers at most; with it, prompts that cannot fit are cut without encoding them."""

    make_encoder: Callable[[], Callable[[str], list[int]]]
    pad_id: int
    eos_id: int
    pad_text: str = PAD_TEXT
    eos_text: str = EOS_TEXT
    longest_token: int | None = None

    def encode(self, text: Column, limit: int | None = None) -> Column:
        make = self.make_encoder

        @F.pandas_udf(IDS)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = make()
            for batch in batches:
                yield batch.map(lambda text: None if text is None else encode(text)[:limit])

        return run(text)

    def count(self, text: Column) -> Column:
        return F.array_size(self.encode(text))

    def drop_specials(self, text: Column) -> Column:
        for special in (self.eos_text, self.pad_text):
            text = F.replace(text, F.lit(special), F.lit(""))
        return text

    def fit_prompt(
        self,
        template: str,
        fields: Mapping[str, Column],
        budget: int,
        cut_field: str = "post",
        cut_text: str = "\n",
        null_text: str = "None",
    ) -> Column:
        """As ``WordTokenizer.fit_prompt``. Token counts of such encoders do not add up, so
        the candidates are tried in order."""
        before, after = Template.parse(template).around(cut_field)
        make, longest = self.make_encoder, self.longest_token

        @F.pandas_udf("string")
        def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            encode = make()

            def fit(head: str, field: str, tail: str) -> str | None:
                while True:
                    if longest is not None:  # longer candidates have more tokens than the budget
                        field = longest_that_may_fit(field, cut_text, budget * longest - len(head) - len(tail))
                    if len(encode(head + field + tail)) <= budget:
                        return head + field + tail
                    if not field:
                        return None
                    lines, found, _ = field.rpartition(cut_text)
                    field = lines if found else field[:-1]

            for heads, bodies, tails in batches:
                yield pd.Series([fit(*row) for row in zip(heads, bodies, tails)], dtype="object")

        field = F.coalesce(fields[cut_field].cast("string"), F.lit(null_text))
        return run(before.render(fields, null_text), field, after.render(fields, null_text))

