"""Token counts from a compiled finite-state tokenizer.

Two transducers do the work, and neither builds tokens.

The first cuts texts into pre-tokens. It has a small table of states over character classes, so a chunk of text is a
map from entry state to exit state: the maps of all chunks of a batch are computed in step, composed by a parallel
prefix scan, and each chunk is then run once from the entry state that the scan gives it.

The second reads the bytes of a pre-token. Its transitions carry the change in the number of tokens, so the count is
the sum along the path. A pre-token of over `LONG` bytes is cut into chunks: each chunk is a map from entry state to exit state and
count, walked for the entries that can be met, and the maps of a batch are composed by a prefix scan like those of the first. A state holds what can still matter of the prefix read so far: the longest suffix that begins
some token, with the last token and the relative count at each place in it where a token may still start. The token that ends at the new place is the
one suffix whose neighbour on the left is not merged into it; counts follow from the place where it starts.
The transitions are compiled when first met and shared by all later texts; a batch that finds over `MOST_STATES` starts the table
anew, so it holds no more than those and what one batch adds, a state a byte at most.

Defined results: a null text counts as empty, and an empty text has no tokens. Strings of special tokens inside a text
count as that one token, the library's default; nothing is added, truncated or padded. Texts are whole and independent, so
repeated rows get equal counts and an empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from pagemill.llm.piece_bpe import batches, numbered

MOST_STATES = 150_000
FEW = 40
CHUNK = 64
LEAD = 8
#: Bytes of a pre-token that is walked as a whole, of the chunks of longer ones, and of what is read ahead of a chunk to guess its entry.
LONG = 192
LINK = 96
AHEAD = 48

# Character classes. The letters that contractions are made of stand apart.
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, END, R, V, L, E, STMD = range(12)
CLASSES = 12
LETTERS = {LETTER, R, V, L, E, STMD}
# States, by what was read last.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, MANY_SPACE, ONE_BLANK, MANY_BLANK, QUOTED, QUOTE_R, QUOTE_V, QUOTE_L, CONTRACTED = range(13)
STATES = 13
CUT_HERE, CUT_BEFORE = 1, 2


def _enter(c: int) -> int:
    """The state after a character that starts a pre-token."""
    if c in LETTERS:
        return IN_LETTERS
    return {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE: ONE_SPACE, BLANK: ONE_BLANK, QUOTE: QUOTED, END: START}[c]


def _step(state: int, c: int) -> tuple[int, int]:
    """(next state, cuts). Cuts are settled at most one character late: white space gives up its last character to
    what follows, and 're, 've and 'll are told apart by their third character."""
    white, other = c in (SPACE, BLANK), c in (OTHER, QUOTE)
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if c == {QUOTE_R: E, QUOTE_V: E, QUOTE_L: L}[state]:
            return CONTRACTED, 0
        follow, cuts = _step(IN_LETTERS, c)
        return follow, cuts | CUT_BEFORE
    if c == END or state in (START, CONTRACTED):
        return _enter(c), CUT_HERE
    if state == IN_LETTERS and c in LETTERS or state == IN_NUMBERS and c == NUMBER or state == IN_OTHERS and other:
        return state, 0
    if state in (ONE_SPACE, MANY_SPACE, ONE_BLANK, MANY_BLANK):
        if white:
            return (MANY_SPACE if c == SPACE else MANY_BLANK), 0
        before = CUT_BEFORE if state in (MANY_SPACE, MANY_BLANK) else 0
        if state in (ONE_BLANK, MANY_BLANK):
            return _enter(c), CUT_HERE | before
        return (IN_OTHERS if other else _enter(c)), before
    if state == QUOTED:
        if c in (R, V, L):
            return {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c], 0
        if c == STMD:
            return CONTRACTED, 0
        if other:
            return IN_OTHERS, 0
    return _enter(c), CUT_HERE


_TABLE = [[_step(s, c) for c in range(CLASSES)] for s in range(STATES)]
NEXT = np.array([[x[0] for x in row] for row in _TABLE], np.uint8).ravel()
CUTS = np.array([[x[1] for x in row] for row in _TABLE], np.uint8).ravel()


def _spans(classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens start. `classes` is a batch of texts, each ended by END."""
    n = -(-len(classes) // CHUNK)
    grid = np.full(n * CHUNK, END, np.uint8)
    grid[: len(classes)] = classes
    columns = np.ascontiguousarray(grid.reshape(n, CHUNK).T)

    maps = np.tile(np.arange(STATES, dtype=np.uint8), (n, 1))
    for k in range(LEAD):
        maps = NEXT[maps.astype(np.int16) * CLASSES + columns[k][:, None]]
    settled = (maps == maps[:, :1]).all(axis=1)
    one, rest = np.flatnonzero(settled), np.flatnonzero(~settled)
    single, full = maps[one, 0], maps[rest]
    for k in range(LEAD, CHUNK):
        single = NEXT[single.astype(np.int16) * CLASSES + columns[k][one]]
        full = NEXT[full.astype(np.int16) * CLASSES + columns[k][rest][:, None]]
    maps[one], maps[rest] = single[:, None], full

    step = 1
    while step < n:  # maps[i] becomes the map of all chunks up to i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), axis=1)
        step *= 2

    state = np.concatenate(([np.uint8(START)], maps[:-1, START]))
    cuts = np.empty((CHUNK, n), np.uint8)
    for k in range(CHUNK):
        at = state.astype(np.int16) * CLASSES + columns[k]
        cuts[k] = CUTS[at]
        state = NEXT[at]
    found = cuts.T.ravel()[: len(classes)]
    starts = (found & CUT_HERE) > 0
    starts[:-1] |= (found[1:] & CUT_BEFORE) > 0
    return np.flatnonzero(starts)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class CountTransducer:
    """The compiled tokenizer of one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path, self.library = path, None
        letters = _byte_letters()
        spelled = lambda s: bytes(letters[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.token = {bytes([b]): b for b in range(256)}
        self.parents: list[tuple[int, int] | None] = [None] * 256
        self.merge: dict[tuple[int, int], int] = {}
        for left, right in merges:
            pair = (self.token[spelled(left)], self.token[spelled(right)])
            self.merge[pair] = self.token[spelled(left + right)] = len(self.parents)
            self.parents.append(pair)
        self.spelling = {i: t for t, i in self.token.items()}
        begun: dict[bytes, list[int]] = {}
        for t, i in self.token.items():
            for k in range(1, len(t)):
                begun.setdefault(t[:k], []).append(i)
        self.begins = {w: frozenset(ids) if len(ids) <= FEW else None for w, ids in begun.items()}
        self.carried: dict = {}
        specials = [t["content"] for t in spec.get("added_tokens", ())]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.spines: tuple[dict, dict] = ({}, {})
        self.apart: dict[tuple[int, int], bool] = {}
        self.classes = np.full(0x110000, 255, np.uint8)
        for c in range(128):
            self.classes[c] = self._class(c)
        self._clear()

    # --- pre-tokens

    def _class(self, point: int) -> int:
        c = chr(point)
        if c in "rvle":
            return {"r": R, "v": V, "l": L, "e": E}[c]
        if c in "stmd":
            return STMD
        if c in " '":
            return SPACE if c == " " else QUOTE
        kind = unicodedata.category(c)
        if kind == "Cn":
            return self._ask(c)
        if kind[0] == "L":
            return LETTER
        if kind[0] == "N":
            return NUMBER
        return BLANK if kind[0] == "Z" or c in "\t\n\v\f\r\x85" else OTHER

    def _ask(self, c: str) -> int:
        """A character that this Python doesn't know yet, by how the library parts it from a letter and a digit."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        split = self.library.pre_tokenizer.pre_tokenize_str
        if len(split(f"a{c}a")) == 1:
            return LETTER
        return NUMBER if len(split(f"1{c}1")) == 1 else OTHER

    def pre_tokens(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(all pre-tokens, the text of each)."""
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self.classes[points]
        for c in np.unique(points[classes == 255]).tolist():
            self.classes[c] = self._class(c)
            classes[points == c] = self.classes[c]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        classes[ends] = END
        starts = _spans(classes)
        stops = np.append(starts[1:], len(classes))
        real = classes[starts] != END
        starts, stops = starts[real], stops[real]
        return [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.searchsorted(ends, starts)

    # --- counts

    def _clear(self) -> None:
        self.states = [(b"", (-1,), (0,))]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, int] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at a token's right (side 1) or left (0) edge while it is built, with the rank at which each is merged away."""
        found = self.spines[side].get(token)
        if found is None:
            found, gone, t = [], len(self.parents), token
            while True:
                found.append((t, gone))
                if self.parents[t] is None:
                    break
                gone, t = t, self.parents[t][side]
            self.spines[side][token] = found
        return found

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether no merge ever joins an edge of `left` to an edge of `right` while both tokens are built.

        Merges run by rank, equal ones from the left, so an edge on the left is gone when its own merge has the same rank.
        """
        known = self.apart.get((left, right))
        if known is None:
            known = True
            for a, gone_a in self._spine(left, 1):
                for b, gone_b in self._spine(right, 0):
                    rank = self.merge.get((a, b))
                    if rank is not None and (when := max(rank, a, b)) < gone_a and when <= gone_b:
                        known = False
            if len(self.apart) > 4 * MOST_STATES:
                self.apart.clear()
            self.apart[left, right] = known
        return known

    def _may_follow(self, last: int | frozenset | None, token: int) -> bool:
        if isinstance(last, frozenset):
            return token in last
        return last is not None and (last == -1 or self._stay_apart(last, token))

    def _carry(self, last: int | frozenset | None, begun: bytes) -> int | frozenset | None:
        """What a state keeps of the token before a place from which `begun` has been read: the tokens that can still
        start there where they are few, None where there are none, else the token itself."""
        if last is None or begun not in self.begins:
            return None
        known = self.carried.get((last, begun), -2)
        if known == -2:
            known, ahead = last, self.begins[begun]
            if isinstance(last, frozenset):
                known = frozenset(t for t in last if len(self.spelling[t]) > len(begun) and self.spelling[t].startswith(begun)) or None
            elif ahead is not None:
                known = frozenset(t for t in ahead if self._may_follow(last, t)) or None
            if len(self.carried) > 4 * MOST_STATES:
                self.carried.clear()
            self.carried[last, begun] = known
        return known

    def _compile(self, move: int) -> int:
        """The move of state and byte `move`: the next state times 256, plus the change in the count plus 128."""
        window, last, count = self.states[move >> 8]
        window += bytes([move & 255])
        for start in range(len(window)):
            token = self.token.get(window[start:])
            if token is not None and self._may_follow(last[start], token):
                change = count[start] + 1
                break
        else:
            raise AssertionError("a byte is always a token")
        # Only places from which some token reaches on still matter; the new place always does.
        last = (*(self._carry(x, window[i:]) for i, x in enumerate(last)), token)
        drop = next(i for i, x in enumerate(last) if x is not None)
        count = (*(0 if x is None else c - change for c, x in zip(count, last, strict=False)), 0)
        state = (window[drop:], last[drop:], count[drop:])
        to = self.number.get(state)
        if to is None:
            to = self.number[state] = len(self.states)
            self.states.append(state)
        packed = self.moves[move] = to << 8 | change + 128
        return packed

    def _walk(self, raw: list[bytes], entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit state, tokens) of byte strings from entry states: all walk the transducer in step, the longest first in the array."""
        sizes = np.array([len(r) for r in raw], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(raw), np.uint8)
        begin = (np.cumsum(sizes) - sizes)[order]
        active = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
        state, total = entry[order].astype(np.int64), np.zeros(len(raw), np.int64)
        for k, m in enumerate(active.tolist()):
            moves, back = np.unique(state[:m] << 8 | flat[begin[:m] + k], return_inverse=True)
            known = self.moves
            packed = np.array([known[x] if x in known else self._compile(x) for x in moves.tolist()], np.int64)[back]
            state[:m] = packed >> 8
            total[:m] += (packed & 255) - 128
        left, out = np.empty(len(raw), np.int64), np.empty(len(raw), np.int64)
        left[order], out[order] = state, total
        return left, out

    def count_unique(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        if len(self.states) > MOST_STATES:
            self._clear()
        raw = [p.encode("utf-8", "replace") for p in pieces]
        sizes = np.array([len(r) for r in raw], np.int64)
        short, long = np.flatnonzero(sizes <= LONG), np.flatnonzero(sizes > LONG)
        out = np.empty(len(raw), np.int64)
        out[short] = self._walk([raw[i] for i in short.tolist()], np.zeros(len(short), np.int64))[1]
        if len(long):
            out[long] = self._count_long([raw[i] for i in long.tolist()])
        return out

    def _count_long(self, raw: list[bytes]) -> np.ndarray:
        """Tokens of long byte strings, by composing the state maps of their chunks."""
        cut = [[r[at : at + LINK] for at in range(0, len(r), LINK)] for r in raw]
        chunks = [c for cs in cut for c in cs]
        first = np.cumsum([0, *map(len, cut)])[:-1]
        content = {c: i for i, c in enumerate(dict.fromkeys(chunks))}
        kind = np.fromiter(map(content.__getitem__, chunks), np.int64, len(chunks))
        texts = list(content)
        leads, _ = self._walk([r[max(0, at - AHEAD) : at] for r in raw for at in range(0, len(r), LINK)], np.zeros(len(chunks), np.int64))
        is_first = np.zeros(len(chunks), bool)
        is_first[first] = True
        leads[is_first] = 0
        # Which chunk may follow which: an exit of the one is an entry of the other.
        after = np.unique(np.stack([kind[:-1], kind[1:]], axis=1)[~is_first[1:]], axis=0)
        begin = np.searchsorted(after[:, 0], np.arange(len(texts) + 1))
        maps: dict[tuple[int, int], tuple[int, int]] = {}
        todo = set(zip(kind.tolist(), leads.tolist(), strict=True))
        while todo:
            asked = sorted(todo)
            exits, counts = self._walk([texts[k] for k, _ in asked], np.array([s for _, s in asked], np.int64))
            maps.update(zip(asked, zip(exits.tolist(), counts.tolist(), strict=True), strict=True))
            todo = {(j, e) for (k, _), e in zip(asked, exits.tolist(), strict=True) for j in after[begin[k] : begin[k + 1], 1].tolist()} - maps.keys()
        return self._composed(kind, first, maps)

    @staticmethod
    def _composed(kind: np.ndarray, first: np.ndarray, maps: dict[tuple[int, int], tuple[int, int]]) -> np.ndarray:
        """Counts at the end of each run of chunks that starts at `first`, by a parallel prefix scan over their maps."""
        entries: dict[int, list[int]] = {}
        for k, s in maps:
            entries.setdefault(k, []).append(s)
        width = max(map(len, entries.values()))
        place = {(k, s): i for k, found in entries.items() for i, s in enumerate(found)}
        following = np.append(kind[1:], -1)
        starts = np.zeros(len(kind), bool)
        starts[first] = True
        to, count = np.zeros((len(kind), width), np.int64), np.zeros((len(kind), width), np.int64)
        seen: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        for i, (k, then) in enumerate(zip(kind.tolist(), following.tolist(), strict=True)):
            if (row := seen.get((k, then))) is None:
                told = [maps[k, s] for s in entries[k]]
                row = seen[k, then] = [place.get((then, e), 0) for e, _ in told], [c for _, c in told]
            to[i, : len(row[0])], count[i, : len(row[1])] = row
        # From here a map takes the entry of its run's first chunk, which is the start state, to an entry of the next chunk.
        run = np.cumsum(starts) - 1
        reach = np.arange(len(kind)) - first[run]
        step = 1
        while step <= int(reach.max(initial=0)):
            on = np.flatnonzero(reach >= step)
            via = to[on - step]
            count[on] = count[on - step] + np.take_along_axis(count[on], via, axis=1)
            to[on] = np.take_along_axis(to[on], via, axis=1)
            step *= 2
        last = np.append(first[1:], len(kind)) - 1
        return count[last, [place[int(k), 0] for k in kind[first]]]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        parts = [self.special.split(t) if self.special else [t] for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        totals = np.array([len(p) - 1 for p in parts], np.int64)
        pieces, part = self.pre_tokens([x for p in parts for x in p])
        if pieces:
            codes, unique = numbered(pieces)
            totals += np.bincount(owner[part], weights=self.count_unique(unique)[codes], minlength=len(texts)).astype(np.int64)
        return totals


_transducers: dict[str, CountTransducer] = {}


def transducer(path: str) -> CountTransducer:
    """One transducer per worker process and vocabulary."""
    if path not in _transducers:
        _transducers[path] = CountTransducer(path)
    return _transducers[path]


def token_counts(docs: DataFrame, path: str, *carried: Column, limit: int, text: str = "text") -> DataFrame:
    """`carried` columns, then n_bytes, n_tokens and over_limit (more than `limit` tokens) of every text."""
    named = docs.select(*[c.alias(f"carried_{i}") for i, c in enumerate(carried)], F.col(text).alias("text"))
    kept = [f for f in named.schema.fields if f.name != "text"]
    schema = StructType([*kept, StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = transducer(path)
        for frame in frames:
            tokens, sizes = [], []
            for texts in batches(frame["text"]):
                tokens += counter.count(texts).tolist()
                sizes += [len(t.encode("utf-8", "replace")) for t in texts]
            out = frame.drop(columns="text")
            out["n_bytes"], out["n_tokens"] = np.array(sizes, np.int64), np.array(tokens, np.int64)
            out["over_limit"] = out["n_tokens"] > limit
            yield out

    return named.mapInPandas(run, schema)
