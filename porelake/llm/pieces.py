"""SentencePiece encoding and decoding with merge-type (BPE) vocabularies.

A text's symbols are its characters. An agenda holds the adjacent pairs whose join is a piece of the vocabulary, by score (then
from left to right); the best is joined, its new neighbours go on the agenda, until no pair is left. Symbols that aren't pieces
become bytes. Two neighbouring characters that no piece has side by side are never joined, whatever surrounds them: a text is cut
there, the parts are encoded by themselves, and what comes out of a word is kept for the next ones.

Each batch is checked against the sentencepiece library: all words that the agenda was used for; and of the decoded texts all ids, runs of
bytes and beginnings that a worker meets for the first time."""

import codecs
import functools
import re
import struct
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import keyed, schema, text_of
from .words import chunks

_SPACE = "▁"  # stands for a space inside pieces
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
#: Characters of words whose ids a worker keeps.
_HELD = 4_000_000
#: Runs of bytes and beginnings that a worker has had checked.
_MET = 200_000
#: Longer words have an agenda each, shorter ones are worked on together.
_SHORT = 32


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            c = raw[at]
            at += 1
            out |= (c & 127) << shift
            shift += 7
            if c < 128:
                return out

    while at < len(raw):
        field, wire = divmod(number(), 8)
        if wire == 0:
            yield field, number()
            continue
        n = number() if wire == 2 else 8 if wire == 1 else 4
        yield field, raw[at : at + n]
        at += n


def _each_byte(e: UnicodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


codecs.register_error("each_byte", _each_byte)


class Pieces:
    """A model file's vocabulary: BPE, bytes for what it lacks, no piece of the user's own. Other models are an error."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        trainer, norm, back = (dict(chain.from_iterable(_fields(v) for k, v in model if k == n)) for n in (2, 3, 5))
        made = [dict(_fields(v)) for k, v in model if k == 1]
        names = [p[1].decode() for p in made]
        kinds = [p.get(3, _NORMAL) for p in made]
        if trainer.get(3, 1) != 2 or not trainer.get(35) or trainer.get(24) or not norm.get(5, 1) or not {*kinds} <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError(f"{path}: only BPE models with bytes for unknown characters, spaces before words and no pieces of the user's own")
        self.plain = not norm.get(2) and not norm.get(4)  # else the library normalises
        self.prefix = _SPACE if norm.get(3, 1) else ""
        self.id = {p: i for i, (p, k) in enumerate(zip(names, kinds, strict=True)) if k == _NORMAL}
        self.cost = {p: -struct.unpack("<f", made[i].get(2, bytes(4)))[0] for p, i in self.id.items()}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(names, kinds, strict=True)) if k == _BYTE}
        self.lead = {i for p, i in self.id.items() if self.prefix and p[0] == _SPACE}
        self.control = {i for i, k in enumerate(kinds) if k == _CONTROL}
        self.pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        # ASCII's other characters than letters, and what pieces have beside them, can end a word if no piece has them beside the rest
        marks, inner = {c for c in map(chr, range(128)) if not c.isalpha()}, [p for p in self.pairs if p[0] != _SPACE]
        while (mixed := {c for p in inner for c in p if (p[0] in marks) != (p[1] in marks)} - marks) and len(marks) < 1024 and not any(c.isascii() for c in mixed):
            marks |= mixed
        if any(p[1] == _SPACE != p[0] for p in self.pairs):  # a piece goes on into the next word
            words = "(?s:.+)"
        elif mixed:
            words = f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+"
        else:
            mark = "".join(map(re.escape, sorted(marks)))
            words = f"{_SPACE}*[^{mark}{_SPACE}]+|{_SPACE}*[{mark}]+|{_SPACE}+"
        self.split = re.compile(words).findall
        said = self.said = [bytes([int(p[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN else p.replace(_SPACE, " ").encode() for p, k in zip(names, kinds, strict=True)]
        self.says = pa.array(said, pa.binary())
        self.is_lead, self.is_control, self.is_byte, self.met, self.off = np.zeros((5, len(names)), bool)
        self.is_lead[[*self.lead]] = self.is_control[[*self.control]] = self.is_byte[[*self.byte.values()]] = True
        self.between = next((i for p, i in self.id.items() if p.isascii() and p.isalpha()), None)
        self.apart = self.plain and not back.get(2) and self.between is not None  # a decoded id says the same whatever stands around it
        self.seen: dict[tuple[int, ...], bool] = {}
        self.rare = sorted({c for p in self.id for c in p} - self.id.keys())  # characters that only longer pieces have
        number = self.id | {c: len(names) + i for i, c in enumerate(self.rare)}
        self.symbol = np.full(0x110000, -2, np.int32)
        for c, i in number.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        pairs = sorted((number[a] << 32 | number[b], self.cost[p], i) for p, i in self.id.items() for j in range(1, len(p)) if (a := p[:j]) in number and (b := p[j:]) in number)
        key, cost, to = zip(*pairs, strict=True) if pairs else ((-1,), (0.0,), (0,))
        self.pair_key, self.pair_cost, self.pair_to = np.array(key, np.int64), np.array(cost, np.float32), np.array(to, np.int32)
        self.gap = next(c for c in map(chr, [10, *range(0x110000)]) if c != " " and self.symbol[ord(c)] == -2)
        self.gap_ids, self.alone = self.ids_of(self.gap), self.ids_of(self.prefix)
        self.known: dict[str, bytes] = {}
        self.wrong: set[str] = set()
        self.held = 0

    def joined(self, run: str) -> list[str]:
        """The pieces of a run of characters, by the agenda."""
        parts, cost = list(run), self.cost
        n = len(parts)
        if n == 1:
            return parts
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        agenda = [(c, i, 2) for i in range(n - 1) if (c := cost.get(parts[i] + parts[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            _, i, size = heappop(agenda)
            j = after[i]
            if not parts[i] or j < 0 or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has been joined since
            parts[i] += parts[j]
            parts[j] = ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (c := cost.get(both := parts[i] + parts[k])) is not None:
                    heappush(agenda, (c, i, len(both)))
            k = before[i]
            if k >= 0 and (c := cost.get(both := parts[k] + parts[i])) is not None:
                heappush(agenda, (c, k, len(both)))
        return [p for p in parts if p]

    def ids_of(self, word: str) -> bytes:
        """A word's ids, four bytes each."""
        out, a, pairs = [], 0, self.pairs
        for b in range(1, len(word) + 1):
            if b == len(word) or word[b - 1 : b + 1] not in pairs:
                for p in self.joined(word[a:b]):
                    if (i := self.id.get(p)) is not None:
                        out.append(i)
                    else:
                        out += [self.byte[c] for c in p.encode()]
                a = b
        return np.array(out, np.int32).tobytes()

    def agendas(self, words: list[str]) -> None:
        """Makes known the ids of words of at most _SHORT characters, many at once: a row of `cost` is the agenda of a word, a place for each
        symbol and the one after it; each round joins the best pair of each row that has one."""
        words.sort(key=len)
        ends = [0, *(bisect_right(words, n, key=len) for n in (6, 8, 10, 12, 16, _SHORT))]
        for a, b in zip(ends, ends[1:], strict=False):
            if a < b:
                self._agendas(words[a:b])

    def _agendas(self, words: list[str]) -> None:
        raw = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max()) + 1  # the last place ends each row
        there = np.arange(width) < size[:, None]
        sym = np.full((len(words), width), -1, np.int32)
        sym[there] = np.where(self.symbol[raw] >= 0, self.symbol[raw], -2 - raw)
        cost, to = np.full(sym.shape, np.inf, np.float32), np.full(sym.shape, -1, np.int32)
        cost[:, :-1], to[:, :-1] = self._pair(sym[:, :-1], sym[:, 1:])
        after, before = (np.repeat(np.arange(width)[None] + d, len(words), 0).astype(np.int8) for d in (1, -1))
        row = np.arange(len(words))  # whose agenda isn't empty
        while len(row):
            own = cost[row]
            i = own.argmin(1)
            live = own[np.arange(len(row)), i] < np.inf
            row, i = row[live], i[live]
            j = after[row, i]
            sym[row, i] = to[row, i]
            k, h = after[row, j], before[row, i]  # what stands after and before the joined symbol
            sym[row, j], cost[row, j] = -1, np.inf
            after[row, i], before[row, k] = k, i
            cost[row, i], to[row, i] = self._pair(sym[row, i], sym[row, k])
            r, h, i = row[h >= 0], h[h >= 0], i[h >= 0]
            cost[r, h], to[r, h] = self._pair(sym[r, h], sym[r, i])
        flat, ends = sym[sym != -1], np.cumsum((sym != -1).sum(1)).tolist()
        raw = flat.tobytes()
        odd = ((sym < -1) | (sym >= len(self.said))).any(1).tolist()
        at = 0
        for w, end, o in zip(words, ends, odd, strict=True):
            self.known[w] = np.array([*chain.from_iterable(map(self._bytes, flat[at:end].tolist()))], np.int32).tobytes() if o else raw[4 * at : 4 * end]
            at = end

    def _bytes(self, symbol: int) -> tuple[int, ...]:
        """A symbol's ids: its own, or those of the bytes of a character that is no piece."""
        if 0 <= symbol < len(self.said):
            return (symbol,)
        c = chr(-2 - symbol) if symbol < 0 else self.rare[symbol - len(self.said)]
        return tuple(self.byte[b] for b in c.encode())

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of symbols: the cost of their join (infinite, if it is no piece), and the joined symbol."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = (self.pair_key[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.pair_cost[at], np.float32(np.inf)), np.where(hit, self.pair_to[at], -1)

    def encode(self, texts: list[str], whole: bool = False) -> tuple[list[list[int]], list[bool]]:
        packed, same = self.packed(texts, whole)
        return [np.frombuffer(p, np.int32).tolist() for p in packed], same

    def packed(self, texts: list[str], whole: bool = False) -> tuple[list[bytes], list[bool]]:
        """The texts' ids, four bytes each, and whether the library agrees: on each of the text's words (one that was met before isn't checked again), or on
        the whole text."""
        if self.held > _HELD:
            self.known.clear()
            self.held = 0
        split = [self.split((self.prefix + t.replace(" ", _SPACE) if self.plain else self.library.normalize(t)) if t else "") for t in texts]
        if new := [*set().union(*split).difference(self.known)]:
            if short := [w for w in new if len(w) <= _SHORT]:
                self.agendas(short)
            for w in new:
                if len(w) > _SHORT:
                    self.known[w] = self.ids_of(w)
            self.held += sum(map(len, new))
            if not whole and self.plain:
                self.check(new)
        out = [b"".join(map(self.known.__getitem__, words)) for words in split]
        if whole or not self.plain:
            return out, [a == np.array(b, np.int32).tobytes() for a, b in zip(out, self.library.encode(texts, num_threads=1), strict=True)]
        return out, [not self.wrong or self.wrong.isdisjoint(words) for words in split]

    def check(self, words: list[str]) -> None:
        """Notes the words that the library encodes otherwise than known. 64 words are a text, each behind a character that no piece has;
        if that comes out differently, they are looked at one by one."""

        def agree(group: list[str]) -> bool:
            own = self.gap_ids.join([self.alone, *map(self.known.__getitem__, group)])
            return self.library.encode((self.gap + self.gap.join(group)).replace(_SPACE, " ")) == np.frombuffer(own, np.int32).tolist()

        for i in range(0, len(words), 64):
            if not agree(words[i : i + 64]):
                self.wrong |= {w for w in words[i : i + 64] if not agree([w])}

    def decode(self, ids: list[int]) -> str:
        if self.control.isdisjoint(ids):
            runs = [ids]
        else:  # they say nothing, but bytes on both sides aren't one character
            cuts = [-1, *(i for i, x in enumerate(ids) if x in self.control), len(ids)]
            runs = [ids[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False)]
        text = "".join([b"".join([self.said[i] for i in run]).decode("utf-8", "each_byte") for run in runs])
        first = next((run[0] for run in runs if run), None)
        return text[1:] if first in self.lead else text  # without the prefix

    def decode_all(self, flat: np.ndarray, ends: np.ndarray, whole: bool = False) -> tuple[list[str], np.ndarray]:
        """The texts of many lists of ids, which end at `ends` (the first is where they begin), and whether the library agrees: on each of the
        text's ids between two others, on its runs of bytes and on its first two ids, each of which is asked for once; or on the whole text, for
        all texts or those with ids that say nothing."""
        if len(flat) and not (0 <= flat.min() and flat.max() < len(self.said)):
            raise IndexError("an id that the vocabulary lacks")
        said = self.says.take(pa.array(flat))
        offsets, data = np.frombuffer(said.buffers()[1], np.int32, len(flat) + 1) if len(flat) else np.zeros(1, np.int32), said.buffers()[2]
        raw = memoryview(data) if data is not None else b""
        first, some = ends[:-1], np.diff(ends) > 0
        lead = np.zeros(len(first), bool)
        lead[some] = self.is_lead[flat[first[some]]]  # without the prefix
        a, b = (offsets[first] + lead).tolist(), offsets[ends[1:]].tolist()
        texts = [str(raw[x:y], "utf-8", "each_byte") for x, y in zip(a, b, strict=True)]
        text_of = lambda at: np.searchsorted(ends, at, "right") - 1
        odd = np.zeros(len(first), bool)
        odd[text_of(np.flatnonzero(self.is_control[flat]))] = True
        same = np.ones(len(first), bool)
        if self.apart and not whole:
            same = self._agreed(flat, ends, text_of)
        else:
            odd[:] = True
        for i in np.flatnonzero(odd).tolist():
            ids = flat[ends[i] : ends[i + 1]].tolist()
            texts[i] = self.decode(ids)
            same[i] = texts[i] == self.library.decode(ids)
        return texts, same

    def _agreed(self, flat: np.ndarray, ends: np.ndarray, text_of) -> np.ndarray:
        same = np.ones(len(ends) - 1, bool)
        for i in np.unique(flat[~self.met[flat]]).tolist():
            self.met[i], self.off[i] = True, not self._agrees((self.between, i, self.between))
        if self.off.any():
            same[text_of(np.flatnonzero(self.off[flat]))] = False
        if len(self.seen) > _MET:
            self.seen.clear()
        # runs of bytes end with their text
        here = np.concatenate([[False], self.is_byte[flat], [False]])
        begins = np.zeros(len(flat) + 1, bool)
        begins[ends] = True
        starts, stops = np.flatnonzero(here[1:] & (~here[:-1] | begins)), np.flatnonzero(here[:-1] & (~here[1:] | begins))
        starts, stops = starts[(long := stops - starts > 1)], stops[long]
        for x, y, t in zip(starts.tolist(), stops.tolist(), text_of(starts).tolist(), strict=True):
            same[t] &= self._met((self.between, *flat[x:y].tolist(), self.between))
        for t, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            same[t] &= x == y or self._met(tuple(flat[x : min(y, x + 2)].tolist()))
        return same

    def _met(self, ids: tuple[int, ...]) -> bool:
        if (out := self.seen.get(ids)) is None:
            out = self._agrees(ids)
            if len(ids) <= _SHORT:
                self.seen[ids] = out
        return out

    def _agrees(self, ids: tuple[int, ...]) -> bool:
        return self.decode([*ids]) == self.library.decode([*ids])


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _encode(path: str, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            for lo, texts, _ in chunks(text_of(batch), 1024, 1 << 20):
                ids, same = own.packed([t or "" for t in texts], whole)
                flat = np.frombuffer(b"".join(ids), np.int32)
                ends = (np.cumsum([0, *map(len, ids)]) // 4).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("key")[lo : lo + len(ids)], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(same)], ["key", "ids", "as_library"])

    return run


def encode(docs: DataFrame, keys: list[str], path: str | None = None, whole: bool = False) -> DataFrame:
    """docs(keys, text) -> key (a struct of the keys, whose names may be any), ids (array of int, without begin and end ids), as_library
    (whether the sentencepiece library gives the same).

    Null and empty texts have no ids. Rows are independent of each other: repeated rows give repeated results, an empty table none;
    other columns are not read. A long text takes time in proportion to its length, times the logarithm of its longest run without a cut.
    whole: the library encodes whole texts for the check, at about 2 MB a second; else each different word that a worker meets (again, after
    4 million characters of others), with all the characters that can take part in its pieces."""
    k = keyed(docs, keys)
    return k.mapInArrow(_encode(path or piece_bpe_path(), whole), schema("key int, ids array<int>, as_library boolean", key=k.schema["key"].dataType))


def _decode(path: str, whole: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                ids = part.column("ids")
                sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                texts, same = own.decode_all(ids.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *sizes.tolist()]), whole)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array(same, pa.bool_())], [*part.schema.names, "text", "text_as_library"])

    return run


def decode(encoded: DataFrame, path: str | None = None, whole: bool = False) -> DataFrame:
    """encoded(ids array<int>, and other columns than text and text_as_library) -> the same with text and text_as_library (whether the
    library's decode gives the same).

    whole: the library decodes whole texts for the check, at about 5 MB a second; else what a decoded text is made of, as a worker meets it: each
    id between two letters, each run of bytes, each text's first two ids; and texts with begin or end ids whole. Null ids give an empty text, begin and end ids nothing, bytes that aren't UTF-8 a replacement
    character each; an id that the vocabulary lacks is an error."""
    return encoded.mapInArrow(_decode(path or piece_bpe_path(), whole), StructType([*encoded.schema, StructField("text", StringType()), StructField("text_as_library", BooleanType())]))
