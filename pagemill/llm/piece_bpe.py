"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Texts become flat symbol arrays. A round finds, per word, the pair of neighbours whose merged piece ranks best
(segmented minimum), merges its occurrences from the left at once, and compacts the arrays; a word leaves when none
of its pairs is a piece. Words are the stretches between places that no piece of the vocabulary spans, so merges in
one never touch another: ids are those of the library, while equal words of a batch are merged once.

Decoding gathers the pieces' bytes by id into one flat array and cuts it per text.

Defined results: a null text counts as empty and has no ids; an empty text decodes to an empty text; characters
outside the vocabulary become byte pieces, and byte sequences that are not UTF-8 decode to U+FFFD as in the library.
Texts are independent rows and are never cut short; a batch is bounded by `BATCH_CHARS`, and one longer text is a
batch of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_MARK = "▁"
NO_PAIR = np.int64(2**62)
BATCH_CHARS = 800_000


class _Lookup:
    """Places of int64 keys: open addressing, probed for whole arrays at a time. Negative keys are never found."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.places = np.full(size, -1, np.int64)
        waiting = np.arange(len(keys))
        slots = self._slot(keys)
        while len(waiting):
            free = self.keys[slots] == -1
            _, first = np.unique(np.where(free, slots, -1 - np.arange(len(slots))), return_index=True)
            won = np.zeros(len(slots), bool)
            won[first] = True
            won &= free
            self.keys[slots[won]] = keys[waiting[won]]
            self.places[slots[won]] = waiting[won]
            waiting, slots = waiting[~won], (slots[~won] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slot(keys)
        out = np.where(self.keys[slots] == keys, self.places[slots], -1)
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] != -1) & (keys >= 0))
        slots = slots[open_]
        while len(open_):
            slots = (slots + 1) & (len(self.keys) - 1)
            met = self.keys[slots] == keys[open_]
            out[open_[met]] = self.places[slots[met]]
            on = ~met & (self.keys[slots] != -1)
            open_, slots = open_[on], slots[on]
        return out


class PieceModel:
    """The tables of one vocabulary file: pieces, scores as ranks, merges as pairs of symbols, spannable borders."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        self.unknown = library.unk_id()
        self.pieces = [library.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        byte_ids = [i for i in range(size) if library.is_byte(i)]
        self.byte_id = np.full(256, self.unknown, np.int64)
        for i in byte_ids:
            self.byte_id[int(self.pieces[i][3:-1], 16)] = i
        self.is_byte = np.zeros(size, bool)
        self.is_byte[byte_ids] = True
        self.has_bytes = bool(byte_ids)
        ids = {self.pieces[i]: i for i in plain}
        chars = sorted({c for p in ids for c in p})
        self.symbol_of_char = {c: k for k, c in enumerate(chars)}
        symbols = list(chars)
        at = dict(self.symbol_of_char)
        for p in ids:
            if len(p) > 1:
                at[p] = len(symbols)
                symbols.append(p)
        self.symbols = symbols
        self.id_of_symbol = np.array([ids.get(s, -1) for s in symbols], np.int64)
        order = sorted((i for i in plain if len(self.pieces[i]) > 1), key=lambda i: -library.get_score(i))
        rank = {self.pieces[i]: r for r, i in enumerate(order)}
        pairs, ranks, merged = [], [], []
        for p, r in rank.items():
            for cut in range(1, len(p)):
                left, right = at.get(p[:cut]), at.get(p[cut:])
                if left is not None and right is not None:
                    pairs.append(left * len(symbols) + right)
                    ranks.append(r)
                    merged.append(at[p])
        self.pairs = _Lookup(np.array(pairs, np.int64))
        self.pair_ranks = np.array(ranks, np.int64)
        self.pair_merged = np.array(merged, np.int64)
        borders = {p[i : i + 2] for p in ids for i in range(len(p) - 1)}
        self.borders = _Lookup(np.array(sorted(ord(b[0]) << 21 | ord(b[1]) for b in borders), np.int64))
        self.point_of_symbol = np.array([ord(c) for c in chars], np.int64)
        # Symbols outside the vocabulary never merge and are kept as -1 - code point.
        self.symbol_of_point = -1 - np.arange(0x110000)
        self.symbol_of_point[self.point_of_symbol] = np.arange(len(chars))
        surface = [bytes([int(p[3:-1], 16)]) if self.is_byte[i] else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.is_control = np.array([library.is_control(i) for i in range(size)])
        for i in range(size):
            if self.is_control[i]:
                surface[i] = b""
            elif library.is_unknown(i):
                surface[i] = " ⁇ ".encode()
        self.surface = surface
        self.leads = np.array([p.startswith(SPACE_MARK) for p in self.pieces])

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the pairs stand in the table of merges; -1 for none."""
        return self.pairs.find(np.where((left < 0) | (right < 0), -1, left * len(self.symbols) + right))

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word); a space mark is put before every word."""
        lengths = np.array([len(w) for w in words], np.int64) + 1
        points = np.frombuffer((SPACE_MARK + SPACE_MARK.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        symbols = self.symbol_of_point[points]
        place = np.arange(len(points))
        at = np.full(len(symbols), -1)
        spanned = np.zeros(len(symbols), bool)
        spanned[1:] = (self.borders.find(points[:-1] << 21 | points[1:]) >= 0) & (word[1:] == word[:-1])
        owner = np.cumsum(~spanned) - 1
        at[:-1] = np.where(spanned[1:], self.pair(symbols[:-1], symbols[1:]), -1)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            ranks = np.where(at >= 0, self.pair_ranks[at], NO_PAIR)
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(starts, len(owner)))
            best = np.minimum.reduceat(ranks, starts)
            best_here = np.repeat(best, sizes)
            over = best_here == NO_PAIR
            if over.any():
                done.append((place[over], symbols[over]))
                left = ~over
                symbols, owner, place, at, ranks, best_here = (x[left] for x in (symbols, owner, place, at, ranks, best_here))
                if not len(symbols):
                    break
            chosen = self._leftmost(ranks == best_here)
            merged = self._merged(symbols, owner, place, at, chosen)
            # A merge may bring up a pair that ranks better than the one being merged: then one occurrence at a time.
            n_at = merged[3]
            word_best = np.full(int(owner.max()) + 1, NO_PAIR)
            word_best[owner] = best_here
            better = (n_at >= 0) & (np.where(n_at >= 0, self.pair_ranks[n_at], NO_PAIR) < word_best[merged[1]])
            if better.any():
                hasty = np.zeros(len(word_best), bool)
                hasty[merged[1][better]] = True
                spots = np.flatnonzero(chosen)
                first = np.concatenate(([True], owner[spots][1:] != owner[spots][:-1]))
                chosen[spots[hasty[owner[spots]] & ~first]] = False
                merged = self._merged(symbols, owner, place, at, chosen)
            symbols, owner, place, at = merged
        place, symbols = (np.concatenate([d[i] for d in done]) for i in range(2))
        order = np.argsort(place, kind="stable")
        return self._ids(word[place[order]], symbols[order], len(words))

    @staticmethod
    def _leftmost(wanted: np.ndarray) -> np.ndarray:
        """Of overlapping wanted pairs (runs of neighbours) every other one, from the left."""
        index = np.arange(len(wanted))
        before = np.concatenate(([False], wanted[:-1]))
        run_start = np.maximum.accumulate(np.where(wanted & ~before, index, 0))
        return wanted & ((index - run_start) % 2 == 0)

    def _merged(self, symbols, owner, place, at, chosen):
        """The arrays after the chosen pairs are merged, with the pair table looked up anew beside each merge."""
        new = np.where(chosen, self.pair_merged[at], symbols)
        keep = np.ones(len(symbols), bool)
        keep[1:] = ~chosen[:-1]
        symbols, owner, place, fresh = new[keep], owner[keep], place[keep], chosen[keep]
        at = at[keep].copy()
        redo = fresh.copy()
        redo[:-1] |= fresh[1:]
        spots = np.flatnonzero(redo)
        nxt = np.minimum(spots + 1, len(symbols) - 1)
        inside = (nxt > spots) & (owner[nxt] == owner[spots])
        at[spots] = np.where(inside, self.pair(symbols[spots], symbols[nxt]), -1)
        return symbols, owner, place, at

    def _ids(self, word: np.ndarray, symbols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the final symbols; those without one are spelled in byte pieces, or are the unknown id where there are none."""
        ids = np.where(symbols >= 0, self.id_of_symbol[np.maximum(symbols, 0)], -1)
        strange = ids < 0
        if strange.any():
            size = np.ones(len(ids), np.int64)
            spelled = np.array([self.unknown])
            if self.has_bytes:
                odd = symbols[strange]
                points = np.where(odd >= 0, self.point_of_symbol[np.clip(odd, 0, len(self.point_of_symbol) - 1)], -1 - odd)
                size[strange] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
                raw = points.astype("<u4").tobytes().decode("utf-32-le", "replace").encode()
                spelled = self.byte_id[np.frombuffer(raw, np.uint8)]
            from_bytes = np.repeat(strange, size)
            ids, word = np.repeat(ids, size), np.repeat(word, size)
            ids[from_bytes] = spelled
        return ids, np.bincount(word, minlength=n)


class Encoder:
    """Encodes and decodes batches of texts as flat arrays of ids with the number of ids of each text."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        digits = [f"{i},".encode() for i in range(len(self.model.pieces))]
        self.digits = _Cells(digits)
        self.surface = _Cells(self.model.surface)

    @staticmethod
    def words(text: str) -> list[str]:
        """What follows each first space mark of a run: the rest of the run's marks and the text up to the next space."""
        parts = text.replace(SPACE_MARK, " ").split(" ")
        if "" not in parts:
            return parts
        out, run = [], 0
        for part in parts:
            run += 1
            if part:
                out.append(SPACE_MARK * (run - 1) + part)
                run = 0
        if run:
            out.append(SPACE_MARK * (run - 1))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.words(t) if t else [] for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        flat = [w for ws in split for w in ws]
        if not flat:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        codes, unique = numbered(flat)
        ids, sizes = self.model.merge_words(unique)
        taken = sizes[codes]
        starts = (np.cumsum(sizes) - sizes)[codes]
        ends = np.cumsum(taken)
        at = np.repeat(starts - (ends - taken), taken) + np.arange(int(ends[-1]))
        return ids[at], np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))])

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The texts as the library's decode gives them: without the leading space that encoding adds."""
        m = self.model
        rows = self.surface.rows(ids, lengths)
        stops = np.cumsum(lengths).tolist()
        out = []
        for piece, stop, n in zip(rows, stops, lengths.tolist(), strict=True):
            own = ids[stop - n : stop]
            if n and m.is_control[own].any():
                out.append(self._decode_around_control(own))
                continue
            led = n and m.leads[own[0]]
            out.append(_utf8(piece[1:] if led else piece))
        return out

    def _decode_around_control(self, own: np.ndarray) -> str:
        """Control ids have no text and part the bytes on either side; the first other piece gives up its leading space."""
        runs = np.split(own, np.flatnonzero(self.model.is_control[own]))
        runs = [r[self.model.is_control[r[:1]].sum() :] for r in runs]
        texts = [_utf8(b"".join(self.model.surface[i] for i in r)) for r in runs]
        first = next((k for k, r in enumerate(runs) if len(r)), None)
        if first is not None and self.model.leads[runs[first][0]]:
            texts[first] = texts[first][1:]
        return "".join(texts)

    def digests(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """SHA-256 of each text's decimal ids joined by commas."""
        return [hashlib.sha256(row[:-1]).hexdigest() for row in self.digits.rows(ids, lengths)]


class _Cells:
    """Byte strings by number, laid out so that rows of numbers become rows of bytes by one gather."""

    def __init__(self, cells: list[bytes]):
        self.flat = np.frombuffer(b"".join(cells), np.uint8)
        self.size = np.array([len(c) for c in cells], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def rows(self, numbers: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.start[numbers] - (ends - sizes), sizes) + np.arange(total)
        flat = self.flat[source].tobytes()
        stops = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(lengths)))].tolist()
        return [flat[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]


def _utf8(raw: bytes) -> str:
    """The text of the bytes; every byte that starts no valid sequence becomes one U+FFFD, as in the library."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            try:
                out.append(raw[at:].decode())
                break
            except UnicodeDecodeError as e:
                out.append(raw[at : at + e.start].decode())
                out.append("�")
                at += e.start + 1
        return "".join(out)


def numbered(strings: list[str]) -> tuple[np.ndarray, list[str]]:
    """(the number of each string, the different strings). Strings are told apart by all their characters, NUL at the end too."""
    unique = list(dict.fromkeys(strings))
    place = dict(zip(unique, range(len(unique)), strict=True))
    return np.fromiter(map(place.__getitem__, strings), np.int64, len(strings)), unique


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def batches(frame: pd.Series, most: int = BATCH_CHARS) -> Iterator[list[str]]:
    """The texts of a batch in runs of bounded size."""
    run, size = [], 0
    for text in frame:
        text = text if isinstance(text, str) else ""
        if run and size + len(text) > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def encoded(docs: DataFrame, path: str, *, text: str = "text") -> Column:
    """The ids of a text column as an array column."""

    @F.pandas_udf("array<int>")
    def ids(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for s in series:
            out = []
            for run in batches(s):
                flat, lengths = enc.encode(run)
                out += np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []
            yield pd.Series(out, index=s.index, dtype=object)

    return ids(docs[text])


def decoded(ids: Column, path: str) -> Column:
    """The text of an array column of ids; null for null."""

    @F.pandas_udf("string")
    def texts(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for s in series:
            filled = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in s]
            flat = np.concatenate([np.zeros(0, np.int64), *filled])
            texts = enc.decode(flat, np.array([len(x) for x in filled], np.int64))
            yield pd.Series([None if x is None else t for x, t in zip(s, texts, strict=True)], index=s.index, dtype=object)

    return texts(ids)


def round_trip(docs: DataFrame, path: str, *carried: Column, text: str = "text") -> DataFrame:
    """`carried` columns, then n_tokens, ids_sha256 and decoded_sha256 of every text, without moving ids out of the task."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    named = docs.select(*[c.alias(f"carried_{i}") for i, c in enumerate(carried)], F.col(text).alias("text"))
    kept = [f for f in named.schema.fields if f.name != "text"]
    schema = StructType([*kept, StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for frame in frames:
            out = []
            for texts in batches(frame["text"]):
                ids, lengths = enc.encode(texts)
                plain = [hashlib.sha256(p.encode()).hexdigest() for p in enc.decode(ids, lengths)]
                out += zip(lengths.tolist(), enc.digests(ids, lengths), plain, strict=True)
            done = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=frame.index)
            yield pd.concat([frame.drop(columns="text"), done], axis=1)

    return named.mapInPandas(run, schema)


def encoded_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The columns of `docs` but its text, with ids, n_tokens and whether decoding the ids gives the text back.

    Batches pass as Arrow slices of bounded text, and ids leave as one flat array with offsets, so no list of Python numbers is
    built.
    """
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

    others = [c for c in docs.columns if c != text]
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(text).alias("text"))
    made = [StructField("ids", ArrayType(IntegerType(), False)), StructField("n_tokens", LongType()), StructField("round_trip", BooleanType())]

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in incoming:
            for at, n in slices(batch.column("text")):
                part = batch.slice(at, n)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, lengths = enc.encode(texts)
                same = [a == b for a, b in zip(enc.decode(ids, lengths), texts, strict=True)]
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)), type=pa.list_(pa.field("element", pa.int32(), nullable=False)))
                yield pa.RecordBatch.from_arrays([part.column("row"), held, pa.array(lengths, pa.int64()), pa.array(same, pa.bool_())], ["row", "ids", "n_tokens", "round_trip"])

    coded = named.mapInArrow(run, StructType([named.schema["row"], *made]))
    return coded.select("row.*", "ids", "n_tokens", "round_trip")


def slices(texts, most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of an Arrow string array of bounded size in bytes."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and size + n > most:
            yield start, i - start
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes) - start
