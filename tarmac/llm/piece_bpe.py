"""SentencePiece BPE encoding by merge-type prefix tables, and decoding.

Every prefix of a text has one last token: the last of the prefix's own encoding. A token that an
automaton matches at the end of a prefix is that last token exactly when it is compatible with the last token
of what stands before it, i.e. when both stand as they are in the encoding of their concatenation: a list of
tokens is an encoding when all adjacent pairs are. The table of last tokens is filled from left to
right, and the ids of the whole text are read from it backwards.

A text may be cut wherever no piece of the vocabulary holds the two characters around the cut
next to each other; for white space before a word that is mostly so, and the tables of short words are kept.
"""

from __future__ import annotations

import codecs
import functools
import re
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import Memo, scratch_name, text_or_empty

SPACE = "▁"
_NONE = -1
_NEVER = 1 << 60
#: Characters of a text whose table is kept for other texts that begin with them.
BEGIN = 6


class Rows(list):
    """Results of ``make(row, key)`` in a table per row, all dropped when there are too many."""

    def __init__(self, make, size: int, entries: int = 1 << 19) -> None:
        super().__init__({} for _ in range(size))
        self.make, self.entries, self.held = make, entries, 0

    def add(self, row: int, key):
        if self.held >= self.entries:
            for table in self:
                table.clear()
            self.held = 0
        self.held += 1
        value = self[row][key] = self.make(row, key)
        return value


class Automaton:
    """Finds the patterns that end at each place of a text, the longest first."""

    def __init__(self, patterns: list[str]) -> None:
        self.below: list[dict[str, int]] = [{}]
        self.own = [_NONE]
        for n, pattern in enumerate(patterns):
            state = 0
            for c in pattern:
                if c not in self.below[state]:
                    self.below[state][c] = len(self.below)
                    self.below.append({})
                    self.own.append(_NONE)
                state = self.below[state][c]
            self.own[state] = n
        self.fallback = [0] * len(self.below)
        #: Per state, the (number, length) of every pattern that ends there.
        self.found: list[tuple[tuple[int, int], ...]] = [()] * len(self.below)
        level = [(0, c, child) for c, child in self.below[0].items()]
        depth = 1
        while level:
            for parent, c, state in level:
                back = self.next_state(self.fallback[parent], c) if parent else 0
                self.fallback[state] = back
                own = self.own[state]
                self.found[state] = self.found[back] if own == _NONE else ((own, depth), *self.found[back])
            level = [(state, c, child) for _, _, state in level for c, child in self.below[state].items()]
            depth += 1
        #: By state and character, as far as texts have shown them.
        self.steps = Rows(self.next_state, len(self.below))

    def next_state(self, state: int, c: str) -> int:
        while c not in self.below[state]:
            if not state:
                return 0
            state = self.fallback[state]
        return self.below[state][c]

codecs.register_error("tarmac-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceCodec:
    """Encoder and decoder for one model file of BPE pieces with byte fallback and identity normalisation."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        kinds = [(model.is_control(i) or model.is_unknown(i), model.is_byte(i)) for i in range(size)]
        pieces = [model.id_to_piece(i) for i in range(size)]
        probe = "ﬁ  a \n"
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE) or not all(model.is_byte(model.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
            raise ValueError("expects a model with byte fallback, a space in front and no other normalisation")
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end = model.bos_id(), model.eos_id()
        normal = {p: i for i, (p, (other, byte)) in enumerate(zip(pieces, kinds, strict=True)) if not other and not byte}
        order = {score: n for n, score in enumerate(sorted({model.get_score(i) for i in normal.values()}, reverse=True))}
        self.rank = {p: order[model.get_score(i)] for p, i in normal.items()}
        # What the decoder puts for an id: text as bytes, nothing for control pieces.
        self.shown = [b"" if other else p.replace(SPACE, " ").encode() for p, (other, _) in zip(pieces, kinds, strict=True)]
        for b, i in enumerate(self.byte_ids):
            self.shown[i] = bytes([b])
        self.shown[model.unk_id()] = model.decode([model.unk_id()]).encode()
        self.controls = {i for i in range(size) if model.is_control(i)}
        self.strips = [not byte and not other for other, byte in kinds]
        # Symbols: the pieces that encode to themselves, and characters of pieces that are none themselves.
        histories = {p: self.history(p) for p in normal}
        whole = [p for p in normal if histories[p][0] == len(p) - 1]
        missing = sorted({c for p in normal for c in p} - set(whole))
        self.text_of = whole + missing
        self.length = list(map(len, self.text_of))
        self.packed = [array("I", [normal[p]]).tobytes() for p in whole] + list(map(self._as_bytes, missing))
        self.past = [histories[p][1:] for p in whole] + [self.history(c)[1:] for c in missing]
        self.automaton = Automaton(self.text_of)
        inner = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal)
        self.parts = re.compile("(?s).+" if inner else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        #: By right and left symbol.
        self._compatible = Rows(self._is_compatible, len(self.text_of))
        self._begun = Memo(lambda text: self._go_on([_NONE], 0, text))
        self._kept = Memo(self._encode_part, entries=1 << 18)

    def _as_bytes(self, text: str) -> bytes:
        return array("I", [self.byte_ids[b] for b in text.encode("utf-8")]).tobytes()

    def history(self, text: str) -> tuple[int, list[int], list[str], list[str]]:
        """The merges of a text by themselves, best score first, leftmost on ties.

        Their number, their ranks (with one that never comes at the end), and the first and the last symbol
        before each of them and at the end.
        """
        symbols, rank = list(text), self.rank.get
        ranks, firsts, lasts = [], [symbols[0]], [symbols[-1]]
        while len(symbols) > 1:
            best, at = min((rank(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == _NEVER:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            ranks.append(best)
            firsts.append(symbols[0])
            lasts.append(symbols[-1])
        return len(ranks), [*ranks, _NEVER], firsts, lasts

    def _is_compatible(self, second: int, first: int) -> bool:
        """Whether two symbols next to each other come to be without a merge across their border.

        Both histories go on in the order of their ranks, the left one first on ties; a merge across
        would come when it ranks before the next of the left and not after the next of the right.
        """
        left, _, lasts = self.past[first]
        right, firsts, _ = self.past[second]
        rank = self.rank.get
        i = j = 0
        while True:
            across = rank(lasts[i] + firsts[j], _NEVER)
            if left[i] <= right[j]:
                if across < left[i]:
                    return False
                if left[i] == _NEVER:
                    return True
                i += 1
            else:
                if across <= right[j]:
                    return False
                j += 1

    def last_symbols(self, text: str) -> list[int]:
        """Per prefix of a text, the last symbol of its encoding; none for the empty one and after an unknown character."""
        return self._go_on(*self._begun[text[:BEGIN]], text)[0]

    def _go_on(self, last: list[int], state: int, text: str) -> tuple[list[int], int]:
        """``last``, known for a first part of ``text`` that ends in ``state``, for all of it, and the state then."""
        at = len(last)
        last = last + [_NONE] * (len(text) + 1 - at)
        compatible, steps, found = self._compatible, self.automaton.steps, self.automaton.found
        for c in text[at - 1 :]:
            try:
                state = steps[state][c]
            except KeyError:
                state = steps.add(state, c)
            for symbol, length in found[state]:
                before = last[at - length]
                if before == _NONE:
                    last[at] = symbol
                    break
                fits = compatible[symbol].get(before)
                if compatible.add(symbol, before) if fits is None else fits:
                    last[at] = symbol
                    break
            at += 1
        return last, state

    def _encode_part(self, text: str) -> bytes:
        last, at, back = self.last_symbols(text), len(text), []
        packed, length = self.packed, self.length
        while at:
            symbol = last[at]
            if symbol == _NONE:
                back.append(self._as_bytes(text[at - 1]))
                at -= 1
            else:
                back.append(packed[symbol])
                at -= length[symbol]
        back.reverse()
        return b"".join(back)

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian uint32, without begin and end."""
        if not text:
            return b""
        return b"".join(map(self._kept.__getitem__, self.parts.findall(SPACE + text.replace(" ", SPACE))))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids give nothing, the space in front goes, bytes that are no text give U+FFFD each."""
        shown, inner = self.shown, ids[1:-1]
        first = next((i for i in ids if shown[i]), None)
        if self.controls.isdisjoint(inner):
            whole = b"".join(map(shown.__getitem__, ids)).decode("utf-8", "tarmac-each-byte")
        else:  # bytes on both sides of a control piece are no character
            parts = (b"".join(map(shown.__getitem__, part)) for _, part in groupby(ids, self.controls.__contains__))
            whole = "".join(p.decode("utf-8", "tarmac-each-byte") for p in parts)
        return whole[1:] if first is not None and self.strips[first] and whole.startswith(" ") else whole


@functools.cache
def piece_codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def round_trip_column(text: Column, path: str, ends: bool = True) -> Column:
    """Struct of ``ids``, packed little-endian uint32, and of the ``decoded`` text of those ids."""

    @F.pandas_udf("ids binary, decoded string")
    def round_trip(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = piece_codec(path)
        begin, end = (array("I", [i]).tobytes() if ends else b"" for i in (own.begin, own.end))
        for texts in batches:
            ids = [b"".join([begin, own.encode(t or ""), end]) for t in texts]
            decoded = [own.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in ids]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(decoded, dtype=object)})

    return round_trip(text)


def encode_and_decode(
    df: DataFrame,
    path: str,
    text_col: str = "text",
    ids_col: str = "ids",
    out_col: str = "decoded",
    ends: bool = True,
) -> DataFrame:
    """Add the piece ids of every text, as the library gives them, and the text they decode to.

    ``ids_col`` holds packed little-endian uint32, with begin and end ids where ``ends``. Control pieces in a
    text are ordinary text; characters the model does not know become bytes. Rows are independent:
    repeated rows repeat their ids, a null or empty text has begin and end only, an empty table
    stays empty. Texts are taken whole, and cost grows with their length however long a run without
    spaces is. Columns named ``ids_col`` or ``out_col`` are replaced, others kept.
    """
    both = scratch_name(df, "_both")
    done = df.withColumn(both, round_trip_column(text_or_empty(text_col), path, ends))
    return done.withColumns({ids_col: F.col(both)["ids"], out_col: F.col(both)["decoded"]}).drop(both)
