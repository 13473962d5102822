"""Byte-level BPE by backtracking over longest matches, with exact merges, and its decoding."""

from __future__ import annotations

import base64
import hashlib
import weakref
from itertools import chain
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from catalign.llm.common import give_back, text_slices

# Bytes of pieces, in each of two generations, and number of pairs of tokens that a worker remembers.
CACHED_BYTES, CACHED_PAIRS = 48 << 20, 300_000
# Bytes of text that are encoded before their rows leave the worker.
SLICE_BYTES = 2 << 20
FIRST, SECOND = itemgetter(0), itemgetter(1)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Pieces(dict):
    """Ids of pieces, as numbers and as text, found when first asked for."""

    def __init__(self, encoder: BpeEncoder):
        # A weak link: an encoder and its memory go as soon as the encoder isn't needed.
        self.encoder, self.held = weakref.ref(encoder), 0
        # What was known when the memory was full last; pieces that are asked for again move over.
        self.older: dict[str, tuple[list[int], str]] = {}

    def __missing__(self, piece: str) -> tuple[list[int], str]:
        found = self.older.get(piece)
        if found is None:
            ids = self.encoder().encode_piece(piece.encode())
            found = (ids, ",".join(map(str, ids)))
        if len(piece) <= 64:
            # Two strings, a tuple and a list with their places in the table.
            size = 300 + 4 * len(piece) + 12 * len(found[0])
            if self.held + size > CACHED_BYTES:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self.held += size
            self[piece] = found
        return found


class BpeEncoder:
    """Ids of a text by ``ranks``, each match of ``pattern`` encoded on its own.

    A row of tokens is what the merges produce exactly if every two neighbours are: merging
    the bytes of both gives the same two tokens. So the encoder takes the longest token at each
    place that goes with the one before it, shorter ones if need be, and steps back over a token
    from whose end no way leads on; each end is given up once, which keeps the work linear.
    Bytes become Latin-1 letters so that one automaton finds all tokens at all places.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        # The two tokens that each token's last merge joins; a single byte is its own ends.
        self.heads, self.tails = {}, {}
        for token, rank in ranks.items():
            parts, last = self.merged(token)
            # A token its own merges don't give can only be a whole piece.
            if parts == [rank]:
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
                self.heads[rank], self.tails[rank] = last or (rank, rank)
        self.automaton.make_automaton()
        # The length of each token, and the next shorter token that it begins with (-1: none).
        self.sizes, self.shorter = [0] * (max(ranks.values()) + 1), [-1] * (max(ranks.values()) + 1)
        for rank in self.heads:
            token = self.tokens[rank]
            begins = (ranks.get(token[:size]) for size in range(len(token) - 1, 0, -1))
            self.sizes[rank], self.shorter[rank] = len(token), next((r for r in begins if r in self.heads), -1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self)

    def merged(self, text: bytes) -> tuple[list[int], tuple[int, int] | None]:
        """The merges themselves, for short byte strings: lowest rank first, leftmost of equals; and the last one's sides."""
        parts = [text[i : i + 1] for i in range(len(text))]
        last = None
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if best == 1 << 40:
                break
            last = (self.ranks[parts[at]], self.ranks[parts[at + 1]])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts], last

    def merge(self, text: bytes) -> list[int]:
        return self.merged(text)[0]

    def goes_with(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' bytes give just these two tokens.

        The merges are undone, latest first, on the side that made the later one. If what then touches could
        itself be merged, and earlier than what was undone, it would have been, and the two tokens would
        not have come about. Of equal merges the left one comes first.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        tokens, ranks, heads, tails = self.tokens, self.ranks, self.heads, self.tails
        a, b, bound, known = left, right, 1 << 40, True
        while True:
            if ranks.get(tokens[a] + tokens[b], 1 << 40) < bound:
                known = False
                break
            inner, outer = tails[a], heads[b]
            if inner != a and (a > b or outer == b):
                bound, a = a, inner
            elif outer != b:
                bound, b = b + 1, outer
            else:
                break
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        letters = piece.decode("latin-1")
        # The longest tokens from left to right are the answer wherever they go together.
        longest = [rank for _, (_, rank) in self.automaton.iter_long(letters)]
        if all(map(self.goes_with, longest, longest[1:])):
            return longest
        size, shorter, goes, pairs = self.sizes, self.shorter, self.goes_with, self.pairs.get
        dead = bytearray(len(piece) + 1)
        chosen: list[int] = []
        places: list[int] = []
        place, rank = 0, longest[0]
        while True:
            while rank >= 0:
                end = place + size[rank]
                if not dead[end]:
                    if not chosen:
                        break
                    fits = pairs((chosen[-1], rank))
                    if goes(chosen[-1], rank) if fits is None else fits:
                        break
                rank = shorter[rank]
            if rank < 0:
                # No token leads on from here; the one that led here is tried shorter.
                dead[place] = 1
                place, rank = places.pop(), shorter[chosen.pop()]
                continue
            chosen.append(rank)
            places.append(place)
            place = end
            if place == len(piece):
                return chosen
            rank = next(self.automaton.iter_long(letters, place))[1][1]

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids, and the same as decimal numbers joined by commas."""
        known = list(map(self.pieces.__getitem__, self.pattern.findall(text)))
        return list(chain.from_iterable(map(FIRST, known))), ",".join(map(SECOND, known))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


# The encoder and the list of tokens a worker built last, by the vocabulary's content and the pattern.
_encoders: dict[tuple, BpeEncoder] = {}
_token_lists: dict[str, list[bytes]] = {}


def _vocabulary(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


def _shared(df: DataFrame, path: str):
    """The vocabulary file, broadcast as it is (it has a fixed size of about a megabyte), and its digest.

    The file is read on the driver only.
    """
    with open(path, "rb") as file:
        content = file.read()
    return df.sparkSession.sparkContext.broadcast(content), hashlib.md5(content).hexdigest()


def _encoder(content, key: tuple) -> BpeEncoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = BpeEncoder(_vocabulary(content.value), key[1])
    return _encoders[key]


def _token_list(content, key: str) -> list[bytes]:
    if key not in _token_lists:
        ranks = _vocabulary(content.value)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        _token_lists.clear()
        _token_lists[key] = tokens
    return _token_lists[key]


def _give_back() -> None:
    """Free what a worker remembers at the end of a task: it is used again by stages that need the memory."""
    _encoders.clear()
    _token_lists.clear()
    give_back()


def _with_columns(df: DataFrame, new: list[tuple[str, T.DataType]], fill) -> DataFrame:
    """``df`` plus columns that ``fill(part)`` computes for an Arrow slice; columns already called so are replaced.

    All other columns stay as they are, in their order, whatever they are called.
    """
    names = {name.lower() for name, _ in new}
    kept = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in names]
    schema = T.StructType([df.schema.fields[i] for i in kept] + [T.StructField(name, kind) for name, kind in new])

    def filled(batches):
        import pyarrow as pa

        for batch in batches:
            for part in fill.slices(batch):
                columns = [part.column(i) for i in kept] + fill(part)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        _give_back()

    return df.mapInArrow(filled, schema)


class _Encode:
    """Ids of each text of a slice, and whether they decode to the text."""

    def __init__(self, df: DataFrame, path: str, pattern: str, checked: bool):
        self.content, digest = _shared(df, path)
        self.key, self.checked, self.text = (digest, pattern), checked, df.columns.index("text")

    def slices(self, batch):
        return text_slices(batch, self.text, SLICE_BYTES)

    def __call__(self, part) -> list:
        import pyarrow as pa

        own = _encoder(self.content, self.key)
        texts = part.column(self.text).to_pylist()
        ids = [own.encode(text)[0] if text else [] for text in texts]
        columns = [pa.array(ids, pa.list_(pa.int32()))]
        if self.checked:
            columns.append(pa.array([own.decode(found) == (text or "").encode() for found, text in zip(ids, texts)], pa.bool_()))
        return columns


class _Decode:
    def __init__(self, df: DataFrame, path: str, ids: str):
        self.content, self.key = _shared(df, path)
        self.ids = df.columns.index(ids)

    def slices(self, batch):
        return (batch.slice(start, 512) for start in range(0, batch.num_rows, 512))

    def __call__(self, part) -> list:
        import pyarrow as pa

        tokens = _token_list(self.content, self.key)
        return [pa.array([b"".join(map(tokens.__getitem__, own or ())) for own in part.column(self.ids).to_pylist()], pa.binary())]


def encode_documents(docs: DataFrame, path: str, pattern: str, out: str = "ids", check: str | None = None) -> DataFrame:
    """``docs`` plus the array of ids of each whole ``text`` (null: empty) as last column ``out``.

    With ``check``, one more column of that name tells whether the ids decode to the text again. Columns
    already called ``out`` or ``check`` are replaced, all others stay. Rows are encoded one by one, in slices of
    some 2 MB of text, a longer text alone; nothing is shuffled. No text is special: tokens' names in a text
    are ordinary characters. An empty table gives no rows.
    """
    new = [(out, T.ArrayType(T.IntegerType()))] + ([(check, T.BooleanType())] if check else [])
    return _with_columns(docs, new, _Encode(docs, path, pattern, bool(check)))


def decode_documents(rows: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` plus the bytes that their ids stand for (null ids: empty) as last column ``out``.

    Decoding needs the list of tokens only. A column already called ``out`` is replaced.
    """
    return _with_columns(rows, [(out, T.BinaryType())], _Decode(rows, path, ids))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for each row of ``docs(doc_id, text)``.

    The text is encoded and its ids decoded again in one pass, so that only digests leave the
    worker. Null and empty texts have no ids; repeated rows are treated one by one, a very long text in one piece.
    An empty table gives no rows; other columns of ``docs`` play no part.
    """
    content, key = _shared(docs, path)
    key = (key, pattern)

    def digest(batches):
        import pyarrow as pa

        own = _encoder(content, key)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column(1).to_pylist():
                ids, digits = own.encode(text or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(digits.encode()).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(digest, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
