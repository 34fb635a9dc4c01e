"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A split text has exactly one encoding in which every pair of neighbouring tokens is compatible, that is, in
which no merge across their border would have come before the merges inside them. So each prefix has one
last token: of the vocabulary entries that end there (found by a suffix automaton) the one that is compatible
with the last token of the prefix before it. Following these from the end gives the ids without running the
merge loop.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from spanweave.llm.common import column_of, map_batches, scripts_of, texts_of

# Fixed value: how byte-level tokenizers split a text before merging.
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A space next to other white space: there a text can't be cut at its spaces.
_RAGGED = re.compile(r"\s | \s")
#: Entries a worker remembers at most per table, then it starts afresh. About 200 bytes each.
REMEMBERED = 250_000
#: Characters encoded together; their new pieces are encoded in order.
_SLICE = 2 << 20
#: White space in a row that the library's pattern is not trusted with.
LONG_BLANK = 50_000
#: Ids decoded together.
_IDS = 1 << 17
#: Marks an added token among pieces; no text holds this surrogate.
_ADDED = "\udfff"


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary file writes each byte.

    Bytes that print are written as themselves, the others as the letters from 256 on, in order.
    """
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = set(prints)
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and added tokens of a tokenizer file."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        raw = {letter: b for b, letter in enumerate(byte_letters())}
        self.ids: dict[bytes, int] = {bytes(raw[c] for c in t): i for t, i in parsed["model"]["vocab"].items()}
        self.tokens: dict[int, bytes] = {i: t for t, i in self.ids.items()}
        self.added: dict[str, int] = {}
        for one in parsed["added_tokens"]:
            self.added[one["content"]] = one["id"]
            self.tokens.setdefault(one["id"], one["content"].encode())
        #: pair of ids -> (rank of its merge, merged id); parts of each merged token, with the rank
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        by_letters = parsed["model"]["vocab"]
        for rank, pair in enumerate(parsed["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = by_letters[a], by_letters[b]
            self.merges.setdefault((left, right), rank)
            self.parts.setdefault(by_letters[a + b], (rank, left, right))


class SuffixAutomaton:
    """Vocabulary entries that end where a text has been read to, longest first.

    A node is the longest end of the text so far that begins some entry. Moves are worked out when first needed.
    """

    def __init__(self, ids: dict[bytes, int]):
        self.ids = ids
        self.node = {b"": 0}
        for token in ids:
            for n in range(1, len(token) + 1):
                self.node.setdefault(token[:n], len(self.node))
        self.text = list(self.node)
        self.moves: dict[int, int] = {}
        self.ends: list[tuple | None] = [None] * len(self.text)

    def move(self, key: int) -> int:
        """The node after ``key``: a node times 256, plus the byte read."""
        grown = self.text[key >> 8] + bytes([key & 255])
        while grown not in self.node:
            grown = grown[1:]
        to = self.moves[key] = self.node[grown]
        if self.ends[to] is None:
            self.ends[to] = tuple((self.ids[grown[i:]], len(grown) - i) for i in range(len(grown)) if grown[i:] in self.ids)
        return to


class PrefixEncoder:
    """Exact ids of one piece of split text, by the unique last token of each prefix."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.automaton = SuffixAutomaton(vocabulary.ids)
        self.known: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay apart when their bytes are merged together.

        Undo the later of the two innermost merges at the border again and again; where the two halves that
        meet then have a merge of their own that comes before what was undone, they would have been joined.
        """
        merges, parts = self.v.merges, self.v.parts
        undone, inclusive = None, False  # rank of the last undone merge; whether an equal rank wins
        while True:
            rank = merges.get((left, right))
            if rank is not None and (undone is None or rank < undone or (inclusive and rank == undone)):
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            # Of equal merges the left one comes first, so the right one is undone before it, and a border
            # merge of the same rank lies left of it.
            if b is None or (a is not None and a[0] > b[0]):
                undone, inclusive, left = a[0], False, a[2]
            else:
                undone, inclusive, right = b[0], True, b[1]

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. Neighbours share the work on the prefix they have in common, so sort them."""
        moves, move, ends, known = self.automaton.moves, self.automaton.move, self.automaton.ends, self.known
        whole = self.v.ids.get
        # Of each prefix: the automaton's node, the last token and the length of that token.
        nodes, last, sizes, before, out = [0], [-1], [0], b"", []
        for piece in pieces:
            if (token := whole(piece)) is not None:
                out.append([token])
                continue
            shared = 0
            for x, y in zip(piece, before):
                if x != y:
                    break
                shared += 1
            before = piece
            del nodes[shared + 1:], last[shared + 1:], sizes[shared + 1:]
            node = nodes[shared]
            for end in range(shared + 1, len(piece) + 1):
                key = node << 8 | piece[end - 1]
                node = moves.get(key)
                if node is None:
                    node = move(key)
                for token, size in ends[node]:
                    if size == end:
                        break
                    pair = last[end - size] << 20 | token
                    fits = known.get(pair)
                    if fits is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        fits = known[pair] = self.compatible(pair >> 20, token)
                    if fits:
                        break
                nodes.append(node)
                last.append(token)
                sizes.append(size)
            ids, at = [], len(piece)
            while at:
                ids.append(last[at])
                at -= sizes[at]
            ids.reverse()
            out.append(ids)
        return out


class TextEncoder:
    """Ids of whole texts as little-endian 32-bit bytes: equal pieces are encoded once per worker.

    ``encode`` gives the ids of sorted pieces of split text.
    """

    def __init__(self, vocabulary: Vocabulary, encode):
        self.vocabulary, self.encode = vocabulary, encode
        self.findall = regex.compile(SPLIT).findall
        self.known: dict[str, bytes] = {}  # by piece
        self.after: dict[str, bytes] = {}  # by what follows a space, up to the next one
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size > _SLICE:
                yield from self._encoded(part)
                part, size = [], 0
        yield from self._encoded(part)

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.after) > REMEMBERED:
            self.after.clear()
        # A text is a list of strings to look up: those of ``after``, or pieces where it can't be cut at its spaces.
        laid: list[tuple[list[str], list[str]]] = []
        pieces: set[str] = set()
        fresh: set[str] = set()
        for text in texts:
            if _RAGGED.search(text) or (self.special is not None and self.special.search(text)):
                first, rest = self._pieces(text), []
            else:
                start, *rest = text.split(" ")
                first = self._pieces(start)
                fresh.update(rest)
            pieces.update(first)
            laid.append((first, rest))
        fresh.difference_update(self.after)
        made = {part: self._parts(part) for part in fresh}
        pieces.update(*made.values())
        pieces.difference_update(self.known)
        todo = sorted((p.encode("utf-8", "surrogatepass"), p) for p in pieces)
        new = {p: array("i", ids).tobytes() for (_, p), ids in zip(todo, self.encode([b for b, _ in todo]))}
        known = self.known
        for part, of in made.items():
            self.after[part] = b"".join([new.get(p) or known[p] for p in of])
        # A piece with a space is remembered as what follows one.
        known.update((p, x) for p, x in new.items() if p[0] != " ")
        look = self.after.__getitem__
        for first, rest in laid:
            yield b"".join([*[new.get(p) or known[p] for p in first], *map(look, rest)])

    def _pieces(self, text: str) -> list[str]:
        if self.special is None:
            return self.findall(text)
        parts = self.special.split(text)
        for token in parts[1::2]:
            self.known.setdefault(_ADDED + token, array("i", [self.vocabulary.added[token]]).tobytes())
        return [p for i, part in enumerate(parts) for p in ([_ADDED + part] if i % 2 else self.findall(part))]

    def _parts(self, part: str) -> list[str]:
        if part.isalpha():
            return [" " + part]
        if part[:-1].isalpha() and part[-1] in ".,;:!?":
            return [" " + part[:-1], part[-1]]
        return self.findall(" " + part)


@lru_cache(maxsize=2)
def _vocabulary(spec: str) -> Vocabulary:
    return Vocabulary(spec)


@lru_cache(maxsize=2)
def text_encoder(spec: str) -> TextEncoder:
    """One per worker process, whatever the number of tasks it runs."""
    prefixes = PrefixEncoder(_vocabulary(spec))
    gc.freeze()  # the tables stay; looking through them again and again would cost more than encoding
    return TextEncoder(prefixes.v, prefixes.encode)


@lru_cache(maxsize=2)
def library_encoder(spec: str):
    """The same ids from a tokenizer library, for operators to which ids are only a means."""
    import tiktoken

    vocabulary, own = _vocabulary(spec), text_encoder(spec)
    blank = re.compile(r"\s{999,}")
    pattern = SPLIT.replace(r"\P{White_Space}", r"\S").replace(r"\p{White_Space}", r"\s")
    library = tiktoken.Encoding("texts", pat_str=pattern, mergeable_ranks=vocabulary.ids, special_tokens=vocabulary.added)

    def encode(text: str) -> bytes:
        if any(m.end() - m.start() >= LONG_BLANK for m in blank.finditer(text)):
            return next(own([text]))
        return library.encode_to_numpy(text, allowed_special="all").astype("<i4").tobytes()

    return lambda texts: map(encode, texts)


class TokenTable:
    """The bytes of all tokens in one array, by id; ids that the vocabulary lacks are empty."""

    def __init__(self, tokens: dict[int, bytes]):
        held = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)] + [b""]
        self.sizes = np.array([len(t) for t in held], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(held), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of ids, and how many there are before each and in all."""
        none = len(self.sizes) - 1
        ids = np.where((ids < 0) | (ids > none), none, ids)
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[ids] - ends[:-1], sizes)
        at += np.arange(len(at))
        return self.data[at].tobytes(), ends

    def texts(self, lists: pa.ListArray) -> list[str]:
        offsets, values = lists.offsets.to_numpy(), lists.values
        if values.null_count:
            values = values.fill_null(-1)
        values = values.to_numpy()
        if lists.null_count:
            return [self._long(values[a:b]) if there else "" for a, b, there in zip(offsets[:-1], offsets[1:], lists.is_valid().to_pylist())]
        out, at = [], 0
        while at < len(lists):  # lists together, as long as they are few ids; a longer one alone
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _IDS, "right")) - 1)
            if end == at + 1:
                out.append(self._long(values[offsets[at]:offsets[end]]))
            else:
                data, ends = self.bytes_of(values[offsets[at]:offsets[end]])
                cuts = ends[offsets[at:end + 1] - offsets[at]].tolist()
                out += [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
            at = end
        return out

    def _long(self, ids: np.ndarray) -> str:
        return b"".join(self.bytes_of(ids[i:i + _IDS])[0] for i in range(0, len(ids), _IDS)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def token_table(spec: str) -> TokenTable:
    return TokenTable(_vocabulary(spec).tokens)


def read_spec(df: DataFrame, tokenizer: str):
    """The tokenizer file, sent once to each executor. A vocabulary file is a few MB, whatever the data."""
    return df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))


def encode_scripts(scripts: DataFrame, tokenizer: str) -> DataFrame:
    """Token ids of each media's text.

    ``scripts``: ``media_id``, ``text`` (a media's subtitles or transcript as one text); other columns are left
    out. Result: ``media_id``, ``token_ids`` (array of int), one row per input row, repeated rows included. A null
    or empty text has no ids. Strings of added tokens in a text become their ids, as the file says.
    ``tokenizer``: path of a byte-level BPE file on the driver. No shuffle; a text is held whole by one task.
    """
    spec = read_spec(scripts, tokenizer)

    def run(batches):
        encoder = text_encoder(spec.value)
        for batch in batches:
            ids = list(encoder(texts_of(batch)))
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "media_id"), pa.ListArray.from_arrays(pa.array(offsets), values)],
                names=["media_id", "token_ids"])

    return map_batches(scripts_of(scripts), run, StructField("token_ids", ArrayType(IntegerType(), True), True))


def decode_scripts(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """Texts of token ids: adds ``text`` to ``media_id`` and ``token_ids``, one row per input row.

    Null ids, and ids that the vocabulary lacks, decode to nothing; bytes that are no UTF-8 to U+FFFD.
    """
    spec = read_spec(tokens, tokenizer)

    def run(batches):
        table = token_table(spec.value)
        for batch in batches:
            column = column_of(batch, "token_ids")
            texts = pa.array(table.texts(column), pa.string())
            yield pa.RecordBatch.from_arrays([column_of(batch, "media_id"), column, texts], names=["media_id", "token_ids", "text"])

    return map_batches(tokens.select("media_id", "token_ids"), run, StructField("text", StringType(), True),
                       keep=("media_id", "token_ids"))
